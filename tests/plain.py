"""The features of one window by plain loops, which tests hold results against."""

import math


def window_features(close, volume, vol_window=5):
    """log_ret, vol_delta, rolling_vol of a window's prices and volumes."""
    log_ret, vol_delta, rolling_vol = [], [], []
    for i in range(len(close)):
        log_ret.append(math.log(close[i] + 1e-6) - math.log(close[i - 1] + 1e-6) if i else 0.0)
        vol_delta.append(volume[i] - volume[i - 1] if i else 0.0)
        rolling_vol.append(moments(log_ret[-vol_window - 1 :])[1])
    return log_ret, vol_delta, rolling_vol


def moments(values):
    mean = sum(values) / len(values)
    return mean, math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))


def standardised(values):
    mean, scale = moments(values)
    return [(v - mean) / (scale or 1.0) for v in values]


def vwaps(close, volume):
    out, money, total = [], 0.0, 0.0
    for c, v in zip(close, volume, strict=True):
        money, total = money + c * v, total + v
        out.append(money / total if total else None)
    return out

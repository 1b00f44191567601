import hashlib
import random

import duckdb
import pyarrow as pa

from barlane.llm import op08_chat as op

SCHEMA = "conv_id long, turn long, role string, text string, seq string, message string, n_turns string"


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        loss = "".join(t for _, _, role, t in turns if role == "assistant")
        out.append((str(conv), len(turns), digest("".join(f"{role}\n{t}\n" for _, _, role, t in turns)), len(loss), digest(loss)))
    return sorted(out)


def found(df):
    return sorted((str(r["conv_id"]), r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|><|im_start|>assistant ok"), (1, 1, "assistant", "<\\|x<|"), (1, 1, "assistant", "<\\|x<|"),
    (2, 5, "assistant", None), (2, None, None, "first"), (2, 3, "odd\nrole\\n<|im_end|>", "t\n\n"), (None, 0, "assistant", "no id <"),
    (3, 0, "user", "x" * 100_000), (3, 1, "assistant", "\U0001d11e" * 50_000), (4, 2, "assistant", "only<|im_start|"),
]


def test_edge_conversations(spark):
    assert found(op.read_back(op.format_log(op.as_log(table(spark, ROWS))))) == brute(ROWS)


def logged(rows):
    """The log of rows as one task makes it."""
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    cols = [[r[0] for r in ordered], [r[1] for r in ordered], [r[2] or "" for r in ordered], [r[3] or "" for r in ordered]]
    return list(op._log(iter([pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["conv_id", "turn", "role", "text"])])))


def test_every_message_is_folded(monkeypatch):
    rows = ROWS + [(7, t, "assistant", f"turn {t} " * (t * 40)) for t in range(40)]
    seen, most, add = {}, [0], op.Fold.add

    def counted(self, message, event, role, text):
        add(self, message, event, role, text)
        seen.setdefault(event, []).append(message)
        most[0] = max(most[0], len(self.texts))

    monkeypatch.setattr(op.Fold, "add", counted)
    formatted = list(op._format(iter(logged(rows))))
    assert sum(r["n_turns"] for b in formatted for r in b.to_pylist()) == len(rows) == len(seen["start"]) == len(seen["end"])
    assert len(seen["edit"]) > 10 and len(seen["regenerate"]) > 10 and len(seen["delta"]) > len(rows)
    assert most[0] == 1  # closed messages do not wait for the end of their conversation
    got = [r for b in op._digest(iter(formatted)) for r in b.to_pylist()]
    assert sorted((str(r["conv_id"]), r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got) == brute(rows)


def test_closed_messages_stay():
    fold = op.Fold()
    for e in [(1, "start", "user", "a"), (2, "start", "assistant", ""), (2, "end", "", ""), (2, "edit", "", "late"), (1, "delta", "", "b")]:
        fold.add(*e)
    assert list(fold.ready()) == []
    fold.add(1, "end", "", "")
    assert list(fold.ready()) == [("user", "ab"), ("assistant", "")]
    fold.add(2, "start", "user", "again")
    assert list(fold.ready(all_=True)) == [("user", "again")] and not fold.closed


def test_long_conversation_takes_segments(spark, monkeypatch):
    monkeypatch.setattr(op, "SEGMENT", 500)
    rows = [(9, t, "assistant" if t % 2 else "user", f"turn {t} <|") for t in range(300)] + ROWS
    formatted = list(op._format(iter([b.slice(i, 7) for b in logged(rows) for i in range(0, b.num_rows, 7)])))
    assert sum(r["conv_id"] == 9 for b in formatted for r in b.to_pylist()) > 10
    got = [r for b in op._digest(iter(formatted)) for r in b.to_pylist()]
    assert sorted((str(r["conv_id"]), r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got) == brute(rows)


def test_empty(spark):
    assert op.format_log(op.as_log(table(spark, []))).count() == 0
    assert op.read_back(op.format_log(op.as_log(table(spark, [])))).count() == 0


def test_deltas_edits_and_regenerations(spark):
    log = [
        (1, 1, 10, "start", "user", "What"), (1, 2, 10, "delta", None, " now?"), (1, 3, 11, "start", "assistant", ""), (1, 4, 11, "delta", None, "Bad "), (1, 6, 11, "regenerate", None, None),
        (1, 5, 11, "delta", None, "answer"), (1, 7, 11, "delta", None, "Good "), (1, 8, 11, "delta", None, "answer"), (1, 9, 10, "edit", None, "Why?"), (1, 10, 12, "delta", None, "never started"),
        (1, 11, None, "start", "user", "bye"), (2, 1, None, "edit", "user", "nothing"),
    ]
    events = spark.createDataFrame(log, op.EVENTS)
    rows = {r["conv_id"]: r for r in op.format_log(events).collect()}
    assert list(op.parse(rows[1]["text"])) == [("user", "Why?"), ("assistant", "Good answer"), ("user", "bye")]
    assert [rows[1]["text"][s["start"] : s["start"] + s["length"]] for s in rows[1]["loss"]] == ["Good answer"]
    assert rows[2]["text"] == "" and rows[2]["n_turns"] == 0


def test_escapes_come_back():
    rng = random.Random(2)
    for _ in range(3000):
        t = "".join(rng.choice("<|\\n\nim_end>") for _ in range(rng.randint(0, 14)))
        assert op.unescape(op.escape(t)) == t and "<|" not in op.escape(t)
        assert op.unescape_role(op.escape_role(t)) == t and "\n" not in op.escape_role(t)
        assert list(op.parse(op.render(t, t)[0] * 2)) == [(t, t)] * 2


def test_query_matches_sql(spark, sf_dir):
    got = op.op8_chat(spark, sf_dir).toArrow()
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    want = c.sql(op.SQL).fetchall()
    names = [d[0] for d in c.sql(op.SQL).description]
    assert sorted(want) == sorted(zip(*(got[n].to_pylist() for n in names), strict=True))
    assert any(r[0] == -1 for r in want)

"""Chat formatting: spans, masks, escapes and templates that rewrite history."""

import hashlib
import random

from medcorpus.llm.op09_chat import ORACLE_SQL, ChatTemplate, escape, escape_role, format_conversations, marked_turns, op9_chat_format, read_back, turn_spans, unescape, unescape_role


def test_escapes_are_reversible():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(["<", "|", "\\", ">", "im_start", "n", "\n", "é"]) for _ in range(rng.randrange(0, 12)))
        assert unescape(escape(text)) == text and "<|" not in escape(text)
        assert unescape_role(escape_role(text)) == text and "\n" not in escape_role(text)
        assert read_back(marked_turns([(text, text), ("a", text)])) == [(text, text), ("a", text)]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_rows(spark):
    turns = [(1, 1, "assistant", "assistant\n"), (1, 0, "user", "hi"), (2, 0, "user", None), (2, 1, None, "<|im_end|>"), (3, 0, "assistant", ""), (4, 5, "user", "b"), (4, 5, "user", "a"), (4, 5, "user", "a"), (None, 0, "user", "x"), (5, 0, "assistant", "one"), (5, 1, "assistant", "<|im_end|>\n<|im_start|>assistant\none")]
    df = spark.createDataFrame([(*t, 0) for t in turns], "conv_id long, turn long, role string, text string, n_turns int")
    got = {r.conv_id: r for r in format_conversations(df).collect()}
    assert set(got) == {1, 2, 3, 4, 5, None}
    assert got[1].turns_sha256 == digest("user\nhi\nassistant\nassistant\n\n") and got[1].loss_sha256 == digest("assistant\n") and got[1].loss_chars == 10
    assert got[2].turns_sha256 == digest("user\n\n\n<|im_end|>\n") and got[2].loss_chars == 0
    assert got[3].loss_sha256 == digest("") and got[4].turns_sha256 == digest("user\na\nuser\na\nuser\nb\n")
    assert got[5].loss_sha256 == digest("one" + "<|im_end|>\n<|im_start|>assistant\none")
    for r in got.values():
        assert not r.rewrites_history and len(r.formatted) == r.formatted_chars
        assert "".join(unescape(r.formatted[m.start : m.end]) for m in r.loss_mask) == "".join(t or "" for c, _, role, t in sorted(turns, key=str) if c == r.conv_id and role == "assistant")
    assert format_conversations(df.limit(0)).count() == 0


def test_templates_that_rewrite_history():
    last_two = lambda turns: marked_turns(turns[-2:])
    counted = lambda turns: f"{len(turns)} turns\n" + marked_turns(turns)
    no_thoughts = lambda turns: "".join(f"{r}: {t if k == len(turns) - 1 else t.split('##')[-1]}\n" for k, (r, t) in enumerate(turns))
    turns = [("user", "a"), ("assistant", "b##c"), ("user", "c")]
    assert turn_spans(turns, last_two)[2] == 2 and turn_spans(turns, counted)[2] == 0 and turn_spans(turns, no_thoughts)[2] == 2
    assert turn_spans(turns, marked_turns)[2] is None


APPENDING = {
    "plain": (lambda turns: "".join(f"{r}: {t}\n" for r, t in turns), str),
    "stripping": (lambda turns: "".join(f"<|{r}|>{t.strip()}<|end|>" for r, t in turns), str.strip),
    "header": (lambda turns: ("<s>[system]\n" if turns else "<s>") + "".join(f"[{k}:{r}]{t}[/{k}]" for k, (r, t) in enumerate(turns)), str),
    "upper": (lambda turns: "".join(f"{r}={t.upper()};" for r, t in turns), str.upper),
    "same as text": (lambda turns: "".join(f"ok{t}ok" for _, t in turns), str),
}


def test_templates_that_only_append():
    turns = [("user", " user: ok "), ("assistant", "ok"), ("user", "<|end|>x<|assistant|>"), ("assistant", " <|im_end|>\n"), ("assistant", ""), ("assistant", "qz")]
    for name, (render, wrote) in APPENDING.items():
        text, spans, changed = turn_spans(turns, render)
        assert changed is None and text == render(turns), name
        assert [text[a:b] for _, _, a, b in spans] == [wrote(t) for _, t in turns], name
        assert [a for a, *_ in spans[1:]] == [b for _, b, *_ in spans[:-1]], name
    sized = lambda turns: "".join(f"{len(t)}:{t}," for _, t in turns)
    assert [a for _, _, a, _ in turn_spans([("assistant", "a"), ("assistant", "bb" * 9)], sized)[1]] == [2, None]


def test_other_templates_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "a "), (1, 1, "assistant", " <|end|> b "), (2, 0, "assistant", "x" * 300_000)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in format_conversations(df, ChatTemplate(APPENDING["stripping"][0])).collect()}
    assert got[1].formatted == "<|user|>a<|end|><|assistant|><|end|> b<|end|>" and not got[1].rewrites_history and got[1].n_turns is None and got[1].turns_sha256 is None
    assert got[1].loss_sha256 == digest("<|end|> b") and got[2].loss_chars == 300_000 and got[1].opaque_turn is None
    last = format_conversations(df, ChatTemplate(lambda turns: marked_turns(turns[-1:]), read_back, unescape)).filter("conv_id = 1").first()
    assert last.rewrites_history and last.changed_turn == 1 and last.loss_chars == 0 and last.n_turns == 1


def test_registered_query_against_its_sql(spark, tmp_path):
    import duckdb

    rows = [(c, k, r, t) for c in range(30) for k, (r, t) in enumerate([("user", f"q<|{c}"), ("assistant", "é<\\|x" * c), ("assistant", None)])]
    spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n_turns int").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    got = op9_chat_format(spark, str(tmp_path))
    want = con.execute(ORACLE_SQL["op9_chat_format"])
    names = [d[0] for d in want.description]
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(want.fetchall())

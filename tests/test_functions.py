"""Text functions, sources, verification and streams on literal rows."""

import json

import pytest
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.functions import verify
from gristmill.operators import chat, tokens
from gristmill.sources import jsonl
from gristmill.streaming import clean


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column).first()[0]


@pytest.mark.parametrize(
    ("value", "column", "want"),
    [
        ("﻿a\r\nb\x00​c\x07\t", lambda: T.pretrain_normal("t"), "a\nbc\t"),
        ("　 x ", lambda: T.strip("t"), "x"),
        ("“a” «b» ‘c’", lambda: T.ascii_quotes("t"), "\"a\" \"b\" 'c'"),
        ("<reponame>x\n<a>y\n\ncode", lambda: T.strip_meta_lines("t"), "code"),
        ("<reponame>x\n<a>y\n\ncode", lambda: T.meta_line_count("t"), 2),
        ("body\n See also \nlinks", lambda: T.trim_wiki_tail("t"), "body"),
        ("É a-b it's", lambda: T.word_count("t"), 3),
        ("One. Two!\nThree", lambda: T.sentence_count("t"), 3),
        ("\n\n ## Title\nx", lambda: T.head_label("t"), "md_heading"),
        ("aaaa", lambda: T.ascii_ratio("t"), 1.0),
        ("x" * 60, lambda: T.placeholder_spam("t"), True),
        ("a b c a b c", lambda: T.distinct_trigrams("t"), 0.75),
        ("12.50%", lambda: T.number_key("t"), "12.5"),
        ("```python\nx = 1\n```", lambda: T.first_code_block("t"), "x = 1\n"),
        ("<think>hm</think> yes", lambda: T.drop_reasoning("t"), "yes"),
        (None, lambda: T.word_count("t"), 0),
        ("short", lambda: T.reject_reason("t"), "too_short"),
        (None, lambda: T.reject_reason("t"), "empty"),
        ("Please summarize this", lambda: T.family_of("t"), "summary_bullets"),
        ("As an AI I can't. print(1)", lambda: F.array_join(T.hard_reasons("t", F.lit("q")), ","), "code_pollution,meta_ai"),
        ("the answer is 4 or 7.5", lambda: T.last_number("t"), 7.5),
    ],
)
def test_text(spark, value, column, want):
    assert one(spark, value, column()) == want


def test_chat(spark):
    rows = [([{"role": "Human", "content": "q\r\n"}, {"role": "gpt", "content": "a"}, {"role": "user", "content": "q2"}],), ([None, {"role": "user", "content": "x"}],), ([],), (None,)]
    df = spark.createDataFrame(rows, "m array<struct<role:string,content:string>>")
    assert [len(r[0]) if r[0] is not None else None for r in df.select(chat.strict(F.col("m"))).collect()] == [3, None, None, None]
    fine = df.select(chat.lenient(F.col("m")).alias("m"))
    assert [len(r.m) for r in fine.collect()] == [3, 1, 0, 0]
    assert fine.select(chat.last_content(F.col("m"), "user")).first()[0] == "q2"
    assert fine.select(F.size(chat.without_trailing_user(F.col("m")))).first()[0] == 2
    assert [m["role"] for m in fine.select(chat.with_system(chat.first_rounds(F.col("m"), 1), "s")).first()[0]] == ["system", "user", "assistant"]
    pair = spark.createDataFrame([("\n\nHuman: hi\n\nAssistant: yes", "\n\nHuman: hi\n\nAssistant: no")], "c string, r string")
    got = pair.select(chat.preference_pair(chat.split_dialogue(F.col("c")), chat.split_dialogue(F.col("r")))).first()[0]
    assert (got["chosen"], got["rejected"], len(got["messages"])) == ("yes", "no", 1)


def test_structure_and_execution():
    good = "def f(x):\n    return x + 1\n"
    assert verify.structure_reasons(good, "f") == []
    assert "banned_node" in verify.structure_reasons("import os\n" + good, "f")
    assert verify.structure_reasons("def f(:", "f") == ["syntax_error"] and verify.structure_reasons(None, None)
    assert "recursion" in verify.structure_reasons("def f(x):\n    return f(x)", "f")
    assert verify.run_tests(good, "f", ["assert f(1) == 2", {"args": [1], "expected": 3}, {"args": ["a"], "raises": "TypeError"}]) == ["ok", "wrong", "ok"]
    assert verify.run_tests("while True: pass", "f", ["assert 1"], seconds=1) == ["timeout"]
    assert verify.code_reward(good, "f", ["assert f(1) == 2"]) == 1.0
    with pytest.raises(KeyError):
        verify.reward("a:1+b:2", {"a": F.lit(1)})


def test_jsonl(spark, tmp_path):
    lines = ['{"text": "ok"}', "", "{bad", '{"text": 5}', '{"x": 1}', '["text"]', '{"text": ""}']
    (tmp_path / "a.jsonl").write_text("\n".join(lines), encoding="utf-8")
    got = {r.value: (r.reason, r.text) for r in jsonl.read_text_lines(spark, str(tmp_path / "a.jsonl")).collect()}
    assert got == {lines[0]: (None, "ok"), lines[2]: ("bad_json", None), lines[3]: ("non_str", None), lines[4]: ("no_field", None), lines[5]: ("no_field", None), lines[6]: ("empty", None)}
    import zstandard

    (tmp_path / "b.jsonl.zst").write_bytes(zstandard.compress("x\ny\n".encode()))
    assert [r.value for r in jsonl.read_zst_lines(spark, str(tmp_path / "b.jsonl.zst")).collect()] == ["x", "y"]
    jsonl.write_lines(spark.createDataFrame([("é", None, 1)], "a string, b string, _c int"), str(tmp_path / "out"))
    assert json.loads("".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("part*"))) == {"a": "é", "b": None}
    assert jsonl.parse_weights(["a:b:1", "c:3"]) == [("a:b", 0.25), ("c", 0.75)]
    assert jsonl.notebook_code('{"cells": [{"cell_type": "code", "source": ["a\\n", "b"]}, {"cell_type": "markdown", "source": "x"}]}') == "a\nb" and jsonl.notebook_code("x") is None


def test_shards_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, [4, 5, 6, 7]), (1, [1, 2, 65535])], "row_id long, ids array<int>")
    sizes = sorted((r.shard[-10:], r.tokens) for r in jsonl.write_shards(df, "ids", str(tmp_path / "s"), 65536, 5).collect())
    assert sizes == [("000000.bin", 5), ("000001.bin", 2)]
    path = str(tmp_path / "s")
    assert sorted((r.path[-5:], r.block, r.ids) for r in jsonl.read_shards(spark, path, 3).collect()) == [("0.bin", 0, [1, 2, 65535])]
    assert sorted((r.path[-5:], r.block, r.ids) for r in jsonl.read_shards(spark, path, 3, keep_rest=True).collect()) == [("0.bin", 0, [1, 2, 65535]), ("0.bin", 1, [4, 5]), ("1.bin", 0, [6, 7])]
    with pytest.raises(Exception, match="out of range"):
        jsonl.write_shards(df, "ids", str(tmp_path / "t"), 100, 5).collect()
    meta = jsonl.manifest([("x/b", 2), ("x/a", 5)], {"train": 7}, 70_000)
    assert meta["tokens"] == 7 and jsonl.shard_kind(meta) and not jsonl.shard_kind(None) and meta["shards"][0] == {"name": "a", "tokens": 5}
    assert jsonl.parse_spec("a:b:0.5") == ("a:b", 0.5, "ratio") and jsonl.parse_spec("a:12") == ("a", 12.0, "count")


def test_metrics_log(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"step": 1, "loss": 2.0}\nbad\n{"step": 2, "val_loss": 1.5}\n{"kind": "bench", "step": 3}\n', encoding="utf-8")
    assert sorted((r.step, r.kind) for r in jsonl.read_metrics(spark, str(tmp_path / "m.jsonl")).collect()) == [(1, "train"), (2, "val"), (3, "bench")]


def test_code_reward_reads_fences_and_infers_names():
    fenced = "Here it is:\n```python\ndef f(x):\n    return x + 1\n```\nDone."
    assert verify.code_reward(fenced, None, ["assert f(1) == 2"]) == 1.0
    assert verify.code_reward(fenced, None, []) == 0.5 and verify.code_reward(fenced, None, ["assert f(1) == 3"]) == 0.5
    assert verify.code_reward("no code", None, ["assert g(1) == 2"]) == 0.0 and verify.code_reward(None, None, None) == 0.0
    assert verify.asserted_name(["x = 1", "assert solve (3) == 4"]) == "solve"


def test_banned_calls():
    for body in ("open('x')", "x.open()", "eval('1')", "x.compile(1)"):
        assert "banned_call" in verify.structure_reasons(f"def f(x):\n    return {body}", "f")
    for body in ("getattr(x, 'a')", "vars(x)", "x.load()"):
        assert "banned_call" not in verify.structure_reasons(f"def f(x):\n    return {body}", "f")


def test_family_reasons(spark):
    limits = "struct<min_words:int,max_words:int,min_sentences:int,max_sentences:int,exact_bullets:int,must_be_email:boolean,must_be_short_message:boolean>"
    data = [
        ("email_message", "Dear Ann,\nOne. Two. Three. Four.\nBest regards", (1, 99, 1, 3, None, True, False)),
        ("email_message", "One. Two. Three.\na\nb\nc\nd", (1, 99, 1, 2, None, False, True)),
        ("explain_compare", "1. An algorithm and its implementation.", (None, None, None, 3, None, False, False)),
        ("explain_compare", "It is a small thing.", None),
    ]
    df = spark.createDataFrame(data, f"family string, a string, c {limits}")
    got = [set(r[0]) for r in df.select(T.family_reasons("a", F.col("family"), F.col("c"))).collect()]
    assert got == [{"email_body_sentence_count"}, {"short_message_sentence_count", "short_message_too_many_lines"}, {"explain_list_format", "too_technical"}, set()]
    scores = spark.createDataFrame([("other", 80), ("other", 91), ("summary_bullets", 60), ("rewrite_style", 35)], "f string, n int").select(T.brevity_score(F.repeat(F.lit("w "), F.col("n")), F.col("f"))).collect()
    assert [r[0] for r in scores] == [4, 2, 5, 4]


def test_payloads(spark):
    df = spark.createDataFrame([('Say "a b" or “longer  one”: now', 'x {"a": {"b": 1}} y'), (None, None), ("none", "{bad}")], "p string, j string")
    got = [tuple(r) for r in df.select(T.longest_quoted("p"), T.after_colon("p"), T.json_object("j").isNotNull()).collect()]
    assert got == [("longer one", "now", True), (None, None, False), (None, None, False)]


def test_chat_encoding(spark):
    messages = [("system", "a"), ("user", "b"), ("assistant", "c <|eos|>"), ("assistant", "d")]
    df = spark.createDataFrame([(1, messages), (2, None), (3, [])], "row_id long, m array<struct<role:string,content:string>>")
    marks = tokens.ChatIds(60000, 60001, 60002, 60003, 50256)
    got = {r.row_id: r for r in tokens.encode_chat(df, "m", marks).collect()}
    ids, labels = got[1].ids, got[1].labels
    assert ids[0] == 60000 and [x for x in ids if x >= 50257] == [60000, 60001, 60002, 60003, 60003] and ids.count(50256) == 2
    first = ids.index(60003)
    assert all(x == -100 for x in labels[: first + 1]) and [x for x in labels if x >= 0] == [x for x in ids[first + 1 :] if x != 60003]
    assert got[2].ids == [60000] == got[3].ids and got[2].labels == [-100]
    cue = {r.row_id: r.ids for r in tokens.encode_chat(df, "m", marks, cue=True).collect()}
    assert cue[1] == [*ids, 60003] and cue[3] == [60000, 60003]


def test_preference_schemas(spark):
    pair = spark.createDataFrame([(" q ", [("user", "q"), ("Assistant", "yes\r\n")], [("assistant", "no")]), ("q", [("user", "q")], [("assistant", "no")]), (None, None, None)], "p string, c array<struct<role:string,content:string>>, r array<struct<role:string,content:string>>")
    got = [r[0] for r in pair.select(chat.pair_of_messages(F.col("p"), F.col("c"), F.col("r"), "S")).collect()]
    assert [m.content for m in got[0].messages] == ["S", "q"] and (got[0].chosen, got[0].rejected) == ("yes\n", "no") and got[1] is None and got[2] is None
    plain = spark.createDataFrame([(" ", "q", "a", "b"), ("Be kind", "q", "", "b")], "s string, q string, c string, r string")
    got = [r[0] for r in plain.select(chat.pair_of_answers(F.col("s"), F.col("q"), F.col("c"), F.col("r"), "S")).collect()]
    assert got[0].messages[0].content == "S" and got[1] is None


def test_stream(spark, tmp_path):
    text = "A plain sentence about nothing. " * 10
    df = spark.createDataFrame([(1, text, "2025-01-01 00:00:00"), (2, text + " ", "2025-01-01 00:10:00"), (3, "short", "2025-01-01 00:20:00")], "id long, text string, at string").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = clean.clean_stream(stream, "text", "at").writeStream.format("memory").queryName("cleaned").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("cleaned").count() == 1

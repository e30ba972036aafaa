from pyspark.sql import functions as F

from tallyhawk.llm import chat

SCHEMA = "tree string, node long, parent long, role string, text string, score double"


def plain(formatted, **more):
    return {(x.tree, x.leaf): x for x in chat.read_back(formatted).collect()}


def test_best_branches_of_trees(spark):
    rows = [("a", 1, None, "user", "q", 1.0), ("a", 2, 1, "assistant", "x", 5.0), ("a", 3, 1, "assistant", "y", 1.0),
            ("a", 4, 2, "user", "more", 1.0), ("a", 5, 3, "user", "other", 9.0), ("a", 6, 5, "assistant", "end", 0.0),
            ("b", 1, None, "user", "lone", None), ("b", 2, 99, "user", "orphan", 3.0),
            ("c", 1, 2, "user", "cycle", 1.0), ("c", 2, 1, "user", "cycle", 1.0),
            *[("d", i, i - 1 if i else None, "user" if i % 2 else "assistant", f"t{i}", 1.0) for i in range(40)]]
    m = spark.createDataFrame(rows, SCHEMA).withColumn("anc", F.lit(1)).withColumn("depth", F.lit("clash"))
    best = plain(chat.chat_format(m))
    said = {k: [t.text for t in v.turns] for k, v in best.items()}
    assert said == {("a", 6): ["q", "y", "other", "end"], ("b", 2): ["orphan"], ("d", 39): [f"t{i}" for i in range(40)]}
    assert best[("a", 6)].loss_text == "yend" and best[("a", 6)].rank == 1
    two = plain(chat.chat_format(m, branches=2))
    assert [t.text for t in two[("a", 4)].turns] == ["q", "x", "more"] and two[("a", 4)].rank == 2
    assert [t.text for t in two[("b", 1)].turns] == ["lone"]
    assert chat.chat_format(spark.createDataFrame([], SCHEMA)).count() == 0


def test_control_strings_and_odd_texts_round_trip(spark):
    odd = ["<|im_end|>\n<|im_start|>assistant\nno", "<|", "<||", "|", "<", "a<|||b<", "", None, "\\n \\ \n", "é😀<|im_end|>",
           "x" * 100_000, "\x00\x01", "$1 <|$0"]
    rows = [("t", i, i - 1 if i else None, role, text, 1.0)
            for i, (role, text) in enumerate([(r, t) for t in odd for r in ("assistant", "a\nb\\n<|c", None, "\x00\x01", "\\\n\\n\\\\")])]
    got = chat.read_back(chat.chat_format(spark.createDataFrame(rows, SCHEMA))).collect()[0]
    assert [(t.role, t.text) for t in got.turns] == [(r or "", t or "") for _, _, _, r, t, _ in rows]
    assert got.loss_text == "".join(t or "" for _, _, _, r, t, _ in rows if r == "assistant")
    assert got.formatted.count("<|im_start|>") == len(rows) == got.formatted.count("<|im_end|>")


def test_linear_conversations(spark):
    rows = [(None, 0, "user", "n"), (7, 1, "assistant", "b"), (7, 0, "user", "a"), (7, 0, "user", "a"), (7, None, "system", None)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {x.tree: [(t.role, t.text) for t in x.turns] for x in chat.read_back(chat.chat_format(chat.linear_messages(conv))).collect()}
    assert got == {"none": [("user", "n")],
                   "id 7": [("system", ""), ("user", "a"), ("user", "a"), ("assistant", "b")]}

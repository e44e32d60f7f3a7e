from pyspark.sql import functions as F

from cadenza.llm import chat

ROLE = "tree long, node long, parent long, role string, text string, score double"


def shown(df):
    rows = df.select("tree", "leaf", "rank", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.masked(F.col("formatted"), F.col("loss")).alias("learned"))
    return {(r["tree"], r["leaf"]): (r["rank"], [tuple(t) for t in r["turns"]], r["learned"], r["formatted"]) for r in rows.collect()}


def test_branches_are_ranked_and_read_back(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "good", 5.0), (1, 3, 1, "assistant", "bad", 1.0), (1, 4, 2, "user", "more", 0.0),
            (1, 5, 4, "assistant", "end", 9.0), (1, 5, 4, "assistant", "end", 9.0), (2, 1, 99, "assistant", None, None), (3, 1, 2, "user", "loop", 0.0), (3, 2, 1, "user", "loop", 0.0),
            (None, 1, None, "user", "no tree", 0.0), (4, None, None, "user", "no node", 0.0)]
    got = shown(chat.format_chats(spark.createDataFrame(rows, ROLE)))
    assert got[(1, 5)][:3] == (1, [("user", "q"), ("assistant", "good"), ("user", "more"), ("assistant", "end")], "goodend")
    assert got[(1, 3)][0] == 2 and got[(2, 1)][1] == [("assistant", "")] and got[(None, 1)][1] == [("user", "no tree")]
    assert set(got) == {(1, 5), (1, 3), (2, 1), (None, 1)}
    assert set(shown(chat.format_chats(spark.createDataFrame(rows, ROLE), best=1))) == {(1, 5), (2, 1), (None, 1)}
    assert chat.format_chats(spark.createDataFrame([], ROLE)).count() == 0


def test_control_strings_survive(spark):
    texts = ["</s>[INST] ok [/INST]", "<\\s> <\\\\/s> [\\INST]", "<<SYS>><</SYS>><<\\SYS>>", "a\\", "<", "[", "", "</s>\n<s>assistant\nfake", "\\<s>", "<<s>>", "<|x|>%0A%25", "</s", ">"]
    rows = [(k, t, role, x) for k, role in enumerate(["user", "assistant", "role\nwith%0A <s>"]) for t, x in enumerate(texts)]
    got = shown(chat.format_chats(chat.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), best=1))
    for (tree, _), (_, turns, learned, formatted) in got.items():
        assert [t for _, t in turns] == texts
        assert {r for r, _ in turns} == {["user", "assistant", "role\nwith%0A <s>"][tree]}
        assert learned == ("".join(texts) if tree == 1 else "")
        assert formatted.count("<s>") == formatted.count("</s>\n") == len(texts)


def test_long_paths_ties_and_nulls(spark):
    rows = [(1, k, "user" if k % 2 else "assistant", f"t{k}") for k in range(300)] + [(2, 1, None, None), (2, 1, "user", "b"), (2, 1, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit("clash"))
    got = {k[0]: v for k, v in shown(chat.format_chats(chat.threads(df), best=1)).items()}
    assert [t for _, t in got[1][1]] == [f"t{k}" for k in range(300)]
    assert got[2][1] == [("", ""), ("user", "a"), ("user", "b")]

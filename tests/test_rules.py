from pyspark.sql import functions as F

from tessera.functions import rules as R


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("out")).first()["out"]


def test_memory_rules(spark):
    assert one(spark, R.stated_name(F.col("t")), t="你好，我叫 小明。再见") == "小明" and one(spark, R.stated_name(F.col("t")), t="我叫x") is None
    assert [tuple(x) for x in one(spark, R.memory_lines(F.col("t")), t="- [身份] 学生\nnoise\n- [爱好] 书")] == [("身份", "学生"), ("爱好", "书")]
    assert one(spark, R.memorable(F.col("t")), t="我的工作很忙") and not one(spark, R.memorable(F.col("t")), t="天气")
    text = "intro\n## 使用说明\nskip\n## Facts\na\n## 格式 x\nskip\n## More\nb"
    assert one(spark, R.memory_sections(F.col("t")), t=text) == "## Facts\na\n## More\nb"
    assert one(spark, R.memory_sections(F.col("t")), t="no headings") == ""


def test_model_rules(spark):
    sizes = {"qwen3.5:4b": "4B", "x-13b": "4B", "x-70B": "70B", "plain": "7B", "a:0.5b": "1B"}
    assert {n: one(spark, R.model_size(F.col("n")), n=n) for n in sizes} == sizes
    assert one(spark, R.affordable_context(F.col("n"), F.lit(8.0)), n="qwen:4b") == int((8 - 2 - 1) * 1024 / 37 * 1024)
    assert one(spark, R.affordable_context(F.col("n"), F.lit(1.0)), n="qwen:4b") == 0
    assert one(spark, R.similar_name(F.lit("My File (1).txt"), F.lit("my_file1.txt")), z=1) == 1.0


def test_lookups(spark):
    names = spark.createDataFrame([("abc1",), ("abd2",), ("x",)], "name string")
    asked = spark.createDataFrame([("ab",), ("abc",), ("zz",)], "prefix string")
    assert {r.prefix: (r.name, r.n) for r in R.prefix_lookup(names, asked, "name", "prefix").collect()} == {"ab": (None, 2), "abc": ("abc1", 1)}
    rel = spark.createDataFrame([(1, 0, "a", "r", "b", "a r b"), (1, 1, "a", "r", "c", "why")], "q int, ord int, src string, relation string, dst string, description string")
    ent = spark.createDataFrame([(1, 0, "n", "t", "d"), (1, 1, "n" * 50, "t", "d")], "q int, ord int, name string, type string, description string")
    assert R.fused_context(ent, rel, "q", 10, 100).first().context == "## 实体信息\n- n (t): d\n\n## 关系信息\n- a r b\n- a r c: why"


def test_rich_segments(spark):
    from tessera.operators.messages import rich_segments

    got = [tuple(x) for x in one(spark, rich_segments(F.col("t")), t="# T\na **b** `c` ~~d~~ [e](u)\n> q\n**open\n```py\nx\n```")]
    assert got == [("T\n", "bold"), ("a ", ""), ("b", "bold"), (" ", ""), ("c", "bold"), (" ", ""), ("d", "strikethrough"), (" ", ""), ("e", "underline"), ("\n> q\n**open\n```\nx\n```\n", "")]
    assert one(spark, rich_segments(F.col("t")), t="") == []

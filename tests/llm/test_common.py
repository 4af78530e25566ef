from tidemark.llm import common


def test_a_worker_holds_the_tools_of_one_operator():
    made = []

    def make(name):
        return lambda: made.append(name) or name

    assert common.tool("a", 1, make("a1")) == common.tool("a", 1, make("again")) == "a1"
    assert common.tool("a", 2, make("a2")) == "a2" and common.tool("b", 1, make("b1")) == "b1"
    assert common.tool("a", 1, make("a1 anew")) == "a1 anew" and made == ["a1", "a2", "b1", "a1 anew"]


def test_free_name(spark):
    df = spark.range(1).selectExpr("id AS __X", "id AS `__x_`")
    assert common.free_name(df, "x") == "__x__" and common.free_name(df, "y") == "__y"


def test_an_operator_without_tools_lets_go_of_another_ones():
    made = []
    common.tool("c", 1, lambda: made.append("a") or "a")
    common.let_go("c")
    assert common.tool("c", 1, lambda: made.append("again")) == "a"
    common.let_go("d")
    assert common.tool("c", 1, lambda: made.append("anew") or "anew") == "anew" and made == ["a", "anew"]

from labelforge.operators import rules as R

CASES = [
    ("compare @nike @adidas", "Chat"),
    ("compare my tabs about shoes", "Chat"),
    ("which of these tabs is best", "Chat"),
    ("compare nike vs adidas", "Search"),
    ("best running shoes nike vs adidas", "Search"),
    ("help", "Chat"),
    ("localhost:8001", "Search"),
    ("go to https://en.wikipedia.org/wiki/Main_Page", "Search"),
    ("site:example.org recipes", "Search"),
    ("weather tomorrow in lyon", "Search"),
    ("write me a poem about the sea", "Chat"),
    ("how do plants turn light into sugar", "Chat"),
    ("blue skirts", "Search"),
    ("the history of the roman empire and its fall", "Search"),
]


def test_p9_rule_chain(spark):
    df = spark.createDataFrame([(q,) for q, _ in CASES], "q string")
    got = [r[0] for r in df.select(R.weak_label("q")).collect()]
    assert got == [lab for _, lab in CASES]


def test_email_is_not_a_mention(spark):
    df = spark.createDataFrame([("mail a@b.com about the invoice please now",)], "q string")
    r = df.select(R.rule_columns("q")["tab_ref"]).collect()[0][0]
    assert r is False


def test_p3_policy_routes_constant_subsets(spark):
    df = spark.createDataFrame([("short", "how are you doing my dear friend"),
                                ("general", "how are you doing my dear friend"),
                                ("unknown_subset", "help")], "subset string, query string")
    got = {r.subset: r.label for r in R.route_labels(df).collect()}
    assert got == {"short": "Search", "general": "Chat", "unknown_subset": "Chat"}


def test_p10_flags(spark):
    df = spark.createDataFrame([("short", "one two three four"), ("chat", "see www.example.com"),
                                ("general", "What are the pros of tea"), ("url", "my tabs")],
                               "subset string, query string")
    got = [r.flags for r in R.rule_flags(df).collect()]
    assert got == ["short_too_long", "chat_has_url", "generic_filler", "tab_ref_in_search"]

from foliant.llm import templates

LONG = "the old miller carried seven sacks of grain across the narrow wooden bridge before sunrise while his two sons waited quietly beside the river with empty baskets and tired horses"
SUM = "Tom has 3 apples and 5 pears. Ann has 7 plums and 2 figs."
NAMED = "every morning the baker Bob walks down to the harbour and sells 12 loaves of bread to the sailors there"


def leaked(spark, item, text):
    docs, items = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string")
    return [r["kind"] for r in templates.leaks(docs, items).collect()]


def test_altered_passages(spark):
    middle = LONG.replace("before sunrise", "long before sunrise")
    assert leaked(spark, LONG, f"Some words first. {LONG}") == ["verbatim"]
    assert leaked(spark, LONG, f"Some words first. {middle}") == ["verbatim"]
    assert leaked(spark, SUM, "Eva has 4 apples and 9 pears. Max has 1 plums and 6 figs.") == ["re-parameterised"]
    assert leaked(spark, NAMED, NAMED.replace("Bob", "Mary Ann").replace("12", "30")) == ["re-parameterised"]
    short = "the small grey cat sleeps under an old oak table in our warm kitchen"
    assert leaked(spark, short, short.replace("under", "quietly under")) == ["verbatim"]


def test_contradicting_slots_are_no_leak(spark):
    assert leaked(spark, "Tom has 3 apples and 3 pears and gives them to Tom and his friend near the gate", "Tom has 3 apples and 5 pears and gives them to Max and his friend near the gate") == []
    assert leaked(spark, SUM, "Nobody has ever seen apples or pears like these. Plums and figs were rare too.") == []


def test_lower_case_sentence_start_still_matches(spark):
    item = "The heavy lorry turned slowly into the muddy field. The driver looked for the broken gate."
    assert leaked(spark, item, "we saw that " + item.lower()) == ["verbatim"]


def test_first_words_that_contradict_each_other_hide_nothing(spark):
    rest = "heavy lorry from the northern quarry turned slowly into the muddy field behind our old stone barn"
    item, text = f"The {rest}. The {rest[::-1]}.", f"A {rest}. Our {rest[::-1]}."
    assert leaked(spark, item, text) != []

from spanwarden.llm import decontamination

ITEM = "Alice Smith bought 5 kg of apples and gave 12 apples to Bob before she counted all the rest again in the evening."
OTHER = "Maria Jones bought 7 lb of apples and gave 31 apples to Peter before she counted all the rest again in the evening."


def found(spark, said, items):
    docs, known = (spark.createDataFrame(x, f"{k} long, text string") for x, k in ((said, "doc_id"), (items, "item_id")))
    return {(r["doc_id"], r["item_id"]) for r in decontamination.matches(docs, known).collect()}


def test_two_variants_of_one_item_in_a_document(spark):
    between = " Then nothing else happened for quite a while in this very long story about a market. "
    third = OTHER.replace("Maria Jones", "Zoe Hill").replace("7 lb", "9 oz").replace("31", "44").replace("Peter", "Hugo")
    assert found(spark, [(1, ITEM + between + OTHER), (2, OTHER + between + third)], [(1, ITEM)]) == {(1, 1), (2, 1)}


def test_items_of_numbers_and_light_edits(spark):
    sums = "Add 12 17 33 48 51 66 72 89 94 105 118 and 127 to get 932"
    numbers = " ".join(str(7 * i + 3) for i in range(12))
    words = [a + b + c for a in "bdfg" for b in "aeiou" for c in ("lor", "min")]
    long = [f"{w}{x}" for x in ("", "s") for w in words][:59]
    item, edited = words[:38], words[:38]
    edited[12], edited[25] = "other", "changed"
    said = [(1, f"See here: {sums} as shown."), (2, f"so {numbers} it"), (3, " ".join(edited)), (4, "As said " + " ".join(long[10:42]) + " and so on"), (5, "nothing of all this is in here at all, but 3 10 17")]
    # the passage in document 4 holds 28 of the 38 words of item 3, too
    assert found(spark, said, [(1, sums), (2, numbers), (3, " ".join(item)), (4, " ".join(long))]) == {(1, 1), (2, 2), (3, 3), (3, 4), (4, 3), (4, 4)}

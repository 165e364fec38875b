"""The identifier dictionary over few and many parts."""

from kinfolk.llm import secrets


def test_identifier_dictionary_does_not_depend_on_the_split(spark):
    rows = [(i, f"foo.bar_baz(x, someName{i % 3}): élan privateWord{i}") for i in range(30)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = (secrets.identifier_dictionary(table.repartition(n)).decode().split("\n") for n in (1, 15))
    assert one == many == ["someName2", "someName1", "someName0", "foo", "bar_baz"]

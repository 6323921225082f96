"""Documents labelled toxic are no part of the trusted target."""

from keylattice.llm import quality


def test_toxic_is_not_trusted(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 1, None), (4, 0, 0), (5, 1, 0), (5, 1, 1), (6, 0, 1)], "doc_id bigint, quality int, toxic int")
    assert sorted(i for part in quality.trusted_ids(labels) for i in part.tolist()) == [1, 3]

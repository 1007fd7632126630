import os

import pytest

SF = "/root/testdata/sf0.001"
given_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are absent")


@pytest.fixture
def frame(spark):
    """A DataFrame from rows and a schema text, over several partitions."""

    def make(rows, schema, parts=3):
        return spark.createDataFrame(rows, schema).repartition(parts)

    return make

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from quire.runtime import ship

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()


ELEMENT = "elem_id bigint, book_id string, page_index int, list_pos int, order_index int, type string, bbox struct<x1:double,y1:double,x2:double,y2:double>, text string, confidence double, inferred_level int, dropped boolean, low_confidence boolean, image_caption string"


@pytest.fixture
def make_elements(spark):
    def make(rows, schema=ELEMENT):
        names = [c.split()[0] for c in ELEMENT.replace("struct<x1:double,y1:double,x2:double,y2:double>", "struct").split(", ")]
        full = []
        for i, r in enumerate(rows):
            base = dict(elem_id=i + 1, book_id="b", page_index=0, list_pos=i, order_index=i, type="text", bbox=(0.0, 100.0 * (i + 1), 500.0, 100.0 * (i + 1) + 40.0), text="", confidence=0.9, inferred_level=None, dropped=False, low_confidence=False, image_caption=None)
            base.update(r)
            full.append(tuple(base[n] for n in names))
        return spark.createDataFrame(full, schema)

    return make

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from contentmark.session import local_session
    s = local_session(cores="*", shuffle_partitions=8)
    yield s


def pages_df(spark, *htmls):
    rows = [(i, f"http://x.example/en/{i}", h) for i, h in enumerate(htmls)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def shredded(spark, *htmls):
    from contentmark.operators import shred as S
    dom = S.shred(pages_df(spark, *htmls), partitions=2).cache()
    return S.nodes(dom), S.texts(dom), S.tokens(dom), S.page_text(dom)


def shredded_dom(spark, *htmls):
    from contentmark.operators import shred as S
    dom = S.shred(pages_df(spark, *htmls), partitions=2).cache()
    return S.nodes(dom), S.texts(dom), S.tokens(dom), S.page_text(dom), dom

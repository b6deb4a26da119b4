"""Documents that have columns named like the operators' own, and the verdicts of the ownership scan."""

import pytest
from pyspark.sql import functions as F

from airops.llm import minhash, secrets

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHES = ["__text_key", "__id", "__key", "__spans", "__hit", "text_key", "TEXT_KEY_", "gone_id", "gone_key", "hit_id",
           "Hit_Key", "masks", "_masks", "masked", "node", "component_id"]
KEY = 'token = "m3Nb8VcX2zLk7JhG" end'
PROSE = " ".join(f"word{k} stands here" for k in range(40))


@pytest.fixture()
def clashing(spark):
    rows = [(1, KEY, "en", "s1", len(KEY)), (2, PROSE, "en", "s1", len(PROSE)), (3, PROSE, None, "s2", len(PROSE)),
            (4, None, "en", None, None), (None, "", "en", "s1", 0)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in CLASHES})


def test_clashing_columns_stay_as_they_are(clashing):
    left = minhash.drop_near_duplicates(clashing)
    assert left.columns == clashing.columns
    assert {r.doc_id for r in left.collect()} == {1, 2, 4, None}
    clean = secrets.redact_secrets(clashing)
    assert clean.columns == clashing.columns and clean.count() == 5
    for df in (left, clean):
        for r in df.collect():
            assert all(r[c] == c + ("-" if r.doc_id is None else str(r.doc_id)) for c in CLASHES)
    assert clean.where("doc_id = 1").first().text == 'token = "<assign:' + secrets_tag("m3Nb8VcX2zLk7JhG") + '>" end'


def secrets_tag(value):
    import hashlib
    return hashlib.sha256(value.encode()).hexdigest()[:8]


def test_only_the_value_is_masked(spark):
    df = spark.createDataFrame([(1, KEY, "en", "s1", len(KEY))], DOCS)
    row = secrets.redact_secrets(df).first()
    assert row.text.startswith('token = "<') and row.text.endswith('>" end') and row.n_chars == len(row.text)


def test_repositories_and_owners_decide_together(spark):
    n = secrets.EXAMPLE_REPOS
    rows = [(k, 'key: token="q8Zk2LmV7xPw9RtY"', "en", f"s{k % 2}", 0) for k in range(n)]  # two owners, many repositories
    rows += [(1000 + k, 'token="m3Nb8VcX2zLk7JhG"', "en", "s1", 0) for k in range(2 * n)]  # one owner, more repositories
    rows += [(2000 + k, 'token="w5Hj9DsA4fQe1TyU"', "en", f"s{k % 2}", 0) for k in range(4)]  # two owners, few repositories
    found, _ = secrets.scan_secrets(spark.createDataFrame(rows, DOCS))
    got = {(r.n_owners, r.n_repos): r.verdict for r in secrets.ownership(found).collect()}
    assert got == {(2, n): "example", (1, 2 * n): "live", (2, 4): "live"}


def test_no_documents(spark):
    none = spark.createDataFrame([], DOCS)
    assert secrets.secret_report(none).count() == 0 and secrets.redact_secrets(none).count() == 0

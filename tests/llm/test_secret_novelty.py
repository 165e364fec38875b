"""Which strings in sensitive context the novelty reports: random ones, not names and paths, in texts of the supplied documents."""

import random
import string

import pytest
from conftest import SMALL

from kinfolk.llm import secrets

NAMED = "getAuthenticationTokenProvider DEFAULT_CONNECTION_TIMEOUT_SECONDS /usr/local/lib/python3/site-packages application/x-www-form-urlencoded".split()
ORDINARY = """com/example/project/service/impl refresh_token_expiration_minutes createUserWithEmailAndPassword SessionCookieConfiguration X-Forwarded-Authorization-Header
user_preferences_table_v2 HttpServletRequestWrapper PrivateKeyInfoFactory-implementation AbstractBeanDefinitionReader content-security-policy-report internationalization_settings
docs/getting-started/installation verifySignatureAlgorithm MAX_RETRY_ATTEMPTS_REACHED node_modules/webpack/hot/dev-server computeChecksumForDirectory""".split()


@pytest.fixture(scope="module")
def reported(spark):
    """Random strings and names, each behind the same words in a text of its own: which of them are reported."""
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    dictionary = secrets.identifier_dictionary(table)
    texts = [r.text[:300] for r in table.orderBy("doc_id").limit(120).collect()]
    draw = random.Random(12)
    kinds = (string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits)
    planted = ["".join(draw.choices(kind, k=n)) for kind in kinds for n in (20, 24, 31, 40) for _ in range(8)]
    rows = [(i, f"{texts[i % len(texts)]} the private credential store uses {s} {texts[-1 - i % len(texts)]}") for i, s in enumerate(planted + NAMED + ORDINARY)]
    found = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), dictionary=dictionary).where("n_novel > 0").collect()
    asked = planted + NAMED + ORDINARY
    texts_of = dict(rows)
    return planted, {asked[r.doc_id] for r in found if asked[r.doc_id] in {texts_of[r.doc_id][int(x.split(':')[1]) : int(x.split(':')[2])] for x in r.spans.split(',')}}


def test_random_strings_are_found(reported):
    planted, found = reported
    assert sum(s in found for s in planted) >= 0.85 * len(planted)


def test_names_and_paths_are_not(reported):
    _, found = reported
    assert not found & set(NAMED)
    assert len(found & set(ORDINARY)) <= 0.2 * len(ORDINARY)


def test_whole_span_is_reported_and_taken_out(spark):
    secret = "Zx9Kq2Lm8Rt5Wv3Yp7Bn4Hd6"
    docs = spark.createDataFrame([(1, f"the signing key is {secret} for now"), (2, f"nothing tells what {secret} is"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secrets.scan(docs, dictionary=b"").collect()}
    assert got == {1: "novel:19:43", 2: "", 3: ""}
    assert {r.text for r in secrets.redacted(docs, dictionary=b"").collect()} == {"the signing key is <novel removed> for now", f"nothing tells what {secret} is", None}

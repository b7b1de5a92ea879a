"""Letters of every script, and copies of a URL."""

import pytest
from pyspark.sql import functions as F

from aquagrid.llm import toxicity, url_filter


@pytest.mark.parametrize("bad, near, good", [
    ("негодяй", "не-годяй", "солнце"), ("κακούργος", "κακούργο", "ήλιος"),
    ("الأحمقون", "الأحمقو", "شمس"), ("最低最悪野郎", "最低最悪野", "今日天気")])
def test_words_of_any_script_meet_their_landmark(bad, near, good):
    same, like, other = toxicity.Kernel([bad]).words([bad, near, good])
    assert same[0] == pytest.approx(1, abs=1e-6) and like is not None and other is None


def test_toxic_texts_in_another_script_are_found(spark):
    plain = ["река течёт тихо", "завтра будет солнце", "книга лежит дома", "дети играют вместе"]
    rows = [(i, f"{plain[i % 4]} {'негодяй' if i % 2 else 'сосед'} номер") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id int, toxic int")
    model = toxicity.fit(docs, labels)
    assert {r.doc_id for r in toxicity.score(docs, model).collect() if r.predicted} == set(range(1, 40, 2))


def test_copies_of_a_url_count_once(spark):
    urls = [(v, f"http://{w}.net/{i}") for v, w in (("allow", "garden"), ("block", "casino")) for i in range(60)]
    once = spark.createDataFrame(urls, "ruled string, url string")
    hot = once.filter("ruled = 'allow'").orderBy(F.xxhash64("url")).first()
    often = once.unionByName(spark.createDataFrame([tuple(hot)] * 200, once.schema))
    (a, cut), (b, other) = (url_filter.fit(df, sample=30) for df in (once, often))
    assert cut == other
    for _, url in urls:
        assert a.score(url.encode()) == b.score(url.encode())

from spindlescope.llm import fuzzy_lines as fl
from spindlescope.llm import sampled_pieces as sm


def test_line_steps_read_few_texts_at_once(spark, monkeypatch):
    docs = spark.range(1300).selectExpr("id AS doc_id", "concat('line of text ', id, '\\nsame') AS text").coalesce(1)
    real = fl._lines

    def few(texts, known):
        assert len(texts) <= 500 and known.most <= 100_000
        return real(texts, known)
    monkeypatch.setattr(fl, "_lines", few)
    assert fl.line_table(docs).count() == 2600


def test_fewer_kept_lattices_give_the_same_samples(spark):
    docs = spark.range(40).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 60), i -> concat('w', pmod(i * id, 37)))) AS text").coalesce(1)
    a, b = (sm.encode_samples(docs, kept=n).select("doc_id", "sample", "ids", "log_prob").orderBy("doc_id", "sample").collect() for n in (300_000, 5))
    assert a == b and len(a) >= 40

from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import corpus, metrics


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_sentences_and_offsets(spark):
    text = "Cats purr. Dogs bark loud. Birds sing."
    spans = [(s.s, s.e) for s in one(spark, X.sentences(F.col("t")), t=text)]
    assert spans == [(0, 10), (11, 26), (27, 38)]
    for offset, sent in [(0, 0), (9, 0), (10, 1), (11, 1), (25, 1), (27, 2), (37, 2), (38, None), (-1, None)]:
        assert one(spark, corpus.sentence_at(X.sentences(F.col("t")), F.col("o")), t=text, o=offset) == sent
    assert one(spark, X.sentences(F.col("t")), t="") == []


def test_locate_takes_the_nearest(spark):
    for given, want in [(5, (6, True)), (2, (2, False)), (0, (2, True))]:
        got = one(spark, corpus.locate(F.col("t"), F.col("a"), F.col("g")), t="a x b x c x", a="x", g=given)
        assert (got.start, got.fixed) == want
    assert one(spark, corpus.locate(F.col("t"), F.col("a"), F.col("g")), t="abc", a="meow", g=0) is None


def test_answer_metrics(spark):
    assert one(spark, X.normalize_answer(F.col("t")), t="The  Denver Broncos!") == "denver broncos"
    assert abs(one(spark, metrics.token_f1(F.col("p"), F.col("t")), p="Denver", t="Denver Broncos") - 2 * 0.5 / 1.5) < 1e-9
    assert one(spark, metrics.token_f1(F.col("p"), F.col("t")), p="Panthers", t="Denver Broncos") == 0
    assert one(spark, metrics.exact_match(F.col("p"), F.col("t")), p="the Denver Broncos", t="Denver Broncos") == 1


def test_small_functions(spark):
    assert one(spark, X.parse_label(F.col("t")), t="The answer: Related.") == "RELATED"
    assert one(spark, X.parse_label(F.col("t")), t="samesame") is None
    assert one(spark, X.document_of(F.col("t")), t="a12p003") == "a12" and one(spark, X.document_of(F.col("t")), t="x") == "x"
    assert one(spark, X.acronym(F.col("t")), t="National Football of the League") == "NFL"
    assert one(spark, X.normalize_concept(F.col("t")), t="The 1,000 Islands’s.") == "1000 islands s"
    assert one(spark, X.numbers(F.col("t")), t="1,000 and 3.5 and 1000") == ["1000", "3.5"]
    assert one(spark, X.negated(F.col("t")), t="It isn't so") and not one(spark, X.negated(F.col("t")), t="a knot")
    got = one(spark, corpus.fuzzy_span(F.col("t"), F.col("s")), t="See Office-Hours, (Monday) 3", s="office hours monday")
    assert (got.s, got.e) == (4, 25)
    assert one(spark, X.clean_answer(F.col("t")), t=' answer: "Paris" \nmore') == "Paris"
    assert one(spark, X.merges_by_string(F.col("t"), F.col("g")), t="in 1998", g="time") is True
    assert one(spark, X.merges_by_string(F.col("t"), F.col("g")), t="later in 1998", g="time") is False

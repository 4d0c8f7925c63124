"""Needles and paragraphs of a pair meet in blocks, and a step that is kept leaves no shuffle files behind."""

import time

from pyspark.sql import functions as F

from quirewise.functions import text as T
from quirewise.operators import locate as L
from quirewise.operators import seek as K
from quirewise.session import cut, kept


def shuffled(spark):
    """Shuffle blocks on the disk of this process."""
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks()
    return sum(blocks.apply(k).toString().startswith("shuffle_") for k in range(blocks.size()))


def test_shuffle_files_go_with_their_step(spark):
    df = spark.range(10_000).repartition(8, "id").groupBy((F.col("id") % 100).alias("k")).count()
    for keep in (cut, kept):
        before = shuffled(spark)
        got = keep(df)
        end = time.time() + 20
        while shuffled(spark) > before and time.time() < end:
            time.sleep(0.2)
        assert shuffled(spark) <= before
        assert got.count() == 100
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def paragraphs(spark):
    texts = ["The river was sampled in spring. It rose again.", "A second river, sampled in autumn.", "3.1", "The river was sampled in sprung by hand.", "The river was sampled in spring. It fell."]
    p = spark.createDataFrame([("P", k, t) for k, t in enumerate(texts)], "pair_id string, number int, text string")
    return p.select("*", T.normalize(F.col("text")).alias("norm"), T.tokens(F.col("text")).alias("words"))


def test_blocks_give_what_the_whole_gives(spark, monkeypatch):
    p = paragraphs(spark)
    n = spark.createDataFrame([("P", "long", "was sampled in spr"), ("P", "two", "river sam"), ("P", "part", "ampl"), ("P", "mark", "."), ("P", "gone", "was sampled by spring"), ("Q", "other", "river")], "pair_id string, needle_id string, norm string")
    want = {("long", k) for k in (0, 3, 4)} | {("part", k) for k in (0, 1, 3, 4)} | {("mark", k) for k in range(5)}
    a = spark.createDataFrame([("P", "like", "The river was sampled in spring"), ("P", "odd", "Nothing of all this")], "pair_id string, needle_id string, raw string").withColumn("norm", T.normalize(F.col("raw")))
    for block in (K.BLOCK, 2):
        monkeypatch.setattr(K.seek, "__defaults__", (0.0, block))
        assert {(r["needle_id"], r["number"]) for r in L.find_texts(n, p).collect()} == want
        # 0 and 4 have a sentence that equals the needle: the first wins.
        assert [(r["needle_id"], r["number"], r["score"]) for r in L.fuzzy_texts(a, p).collect()] == [("like", 0, 1.0)]


def test_words_do_not_move_on_their_own(spark):
    n = spark.createDataFrame([("P", "1", "was sampled in spring")], "pair_id string, needle_id string, norm string")
    plan = L.find_texts(n, paragraphs(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(array_distinct" not in plan


def test_stems_are_those_of_the_engine(spark):
    words = ["studies", "rations", "cities", "city", "rings", "ring", "used", "tree", "bees", "moderately", "naïveness", "o'clock", "is", "1990s", "improvements", "élites"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.stem(F.col("w")).alias("s")).collect()
    assert [r["s"] for r in got] == [T.plain_stem(r["w"]) for r in got]

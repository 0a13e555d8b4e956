"""Plans with large literals aren't described at length in the driver."""

import public_tokenizers
from pyspark.sql import functions as F
from tessera.llm import bpe
from tessera.llm.common import short_plans


def test_descriptions_of_the_encoder_are_short(spark):
    codec = bpe.Codec(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    describe = lambda: len(spark.range(1).select(codec.encode_words(F.array(F.lit("ab")))[0].alias("x"))._jdf.queryExecution().toString())
    before = spark.conf.get("spark.sql.maxPlanStringLength", None)
    with short_plans(spark):
        assert describe() <= 25_000
    assert describe() > 900_000 and spark.conf.get("spark.sql.maxPlanStringLength", None) == before

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import design, responses


def test_tree_is_flat_and_the_parallel_bands_comb(spark):
    freqs = np.geomspace(20, 20_000, 300)
    df = spark.createDataFrame([(float(f),) for f in freqs], "f double")
    own = responses.with_parts(df.withColumn("rate", F.lit(48_000.0)), "f", "rate", 140, 3200)
    db = responses.magnitude_db
    out = own.select(db(responses.tree(F.lit(1.0))).alias("tree"), db(responses.tree(F.lit(0.5))).alias("half"), db(responses.parallel(F.lit(0.5))).alias("comb"), "low_lp_re", "low_lp_im").toPandas()
    assert out["tree"].abs().max() < 1e-6 and out["half"].abs().max() < 1e-6 and out["comb"].min() < -20
    own = design.response(design.lr4("lowpass", 140, 48_000), freqs, 48_000)
    assert np.allclose(out.iloc[:, 3] + 1j * out.iloc[:, 4], own, atol=1e-9)
    bands = design.crossover(140, 3200, 48_000)
    whole = sum(design.response(bands[b], freqs, 48_000) for b in ("low", "mid", "high"))
    assert np.allclose(20 * np.log10(np.abs(whole)), out["tree"], atol=1e-6)

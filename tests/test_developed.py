import numpy as np
from test_grid import array_of, develop_np, image, make

from photolake import schema
from photolake.plans import pixel_queries


def test_query_develops_all_steps_of_the_profile(spark, monkeypatch):
    a = image(8, 9, 3)
    monkeypatch.setattr(pixel_queries, "_cells", lambda spark, d: make(spark, a))
    got = array_of(pixel_queries.developed(spark, ""))
    assert np.allclose(got, develop_np(a, schema.PROFILE, schema.PROFILE["development_steps"]), rtol=1e-9)

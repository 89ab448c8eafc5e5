"""What the driver holds of plans that are done with."""

from lexiloom.llm import common


def test_each_step_of_components_releases_the_last(spark, monkeypatch):
    """A long path takes many steps; garbage is looked for after each, not when the driver's heap is full."""
    released, release = [], common.release

    def counted(session):
        released.append(session)
        release(session)

    monkeypatch.setattr(common, "release", counted)
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    out = common.components(edges)
    assert {(r.vertex, r.component) for r in out.collect()} == {(i, 0) for i in range(61)}
    assert len(released) >= 3

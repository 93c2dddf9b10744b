"""The bundled charts are all the published ones, and queries over charts read them all."""

from glyphforge.queries import QUERIES
from glyphforge.sources.charts import bundled


def test_all_charts_are_bundled_with_sources():
    charts = bundled().charts
    assert len(charts) == 371
    assert all(c["source"] and c["confidence"] and c["graphemes"] for c in charts.values())


def test_votes_count_every_chart(spark, sf_dir):
    assert sum(r.n for r in QUERIES["chart_confidence"](spark, sf_dir).collect()) == 371
    votes = {(r.ipa, r.grapheme): r.votes for r in QUERIES["phoneme_votes"](spark, sf_dir).collect()}
    assert votes["m", "m"] == sum(c["graphemes"].get("m") == "m" for c in bundled().charts.values()) > 300

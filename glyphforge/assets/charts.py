"""The 371 published language charts, so that the library works without a chart folder.

Charts hold facts about orthographies: which unit is written for which sound.  Sources are
named in each chart; see NOTICE.  `charts.jsonl` has a chart a line, without remarks in prose.  Any folder
of chart files (JSON objects with the same fields) can be given instead, see
`glyphforge.sources.charts`.
"""

import json
from importlib.resources import files

# lines end at \n alone: charts may hold other line separators
_LINES = files(__package__).joinpath("charts.jsonl").read_bytes().split(b"\n")

CHARTS = {c["code"]: c for c in (json.loads(line) for line in _LINES if line)}

"""What every style does to the generated battery, against the published digests."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tests.battery import DIGESTS, battery
from typeloom.functions.chars import NARROW_NO_BREAK, NO_BREAK, reveal
from typeloom.operators import engine
from typeloom.plans.styles import STYLES, with_width

LABELLED = {s.name: s for s in STYLES} | {"fr+00A0": with_width(NO_BREAK), "fr+202F": with_width(NARROW_NO_BREAK)}


@pytest.fixture(scope="module")
def inputs(spark):
    rows = list(enumerate(battery()))
    assert len(rows) == 8799
    return spark.createDataFrame(rows, "n int, text string").repartition(4).cache()


@pytest.mark.parametrize("label", LABELLED)
def test_digest(inputs, label):
    style = LABELLED[label]
    place = {r.id: i for i, r in enumerate(style.rules)}
    lines = [f"## {label} {style.id}"]
    for r in style.rules:
        say = lambda x: json.dumps(x, ensure_ascii=False)
        lines.append(f"  rule {r.id} {r.severity} {'fixable' if r.fixable else 'check'} {say(r.summary)} {say(r.cite)}")
    df = engine.find(engine.changed(inputs, style), style)
    rows = df.where(F.col("changed") | (F.size("findings") > 0)).select("n", reveal(F.col("text")).alias("a"), reveal(F.col("fixed")).alias("b"), "findings").orderBy("n").collect()
    for row in rows:
        found = sorted(row.findings, key=lambda f: (place[f.rule], f["index"]))
        lines.append(f"  {row.a} -> {row.b} [{','.join(f'{f.rule}@{f['index']}+{f['length']}' for f in found)}]")
    assert hashlib.sha256("\n".join(lines).encode()).hexdigest()[:12] == DIGESTS[label]


@pytest.mark.parametrize("label", LABELLED)
def test_no_style_breaks_its_promises_on_the_battery(inputs, label):
    assert engine.audit(inputs, LABELLED[label]).count() == 0

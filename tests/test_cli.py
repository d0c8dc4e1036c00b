"""The command-line driver reviews a CSV ledger and writes the packet."""
import json
import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="test tables absent")


def test_cli_review_writes_packet(spark, capsys):
    from ledgerlens.__main__ import main
    from ledgerlens.session import scratch_path
    from ledgerlens.sources.sinks import read_packet
    from ledgerlens.sources.fixture import gl_fixture
    gl = gl_fixture(spark, SF, with_row_id=False)
    src, out = scratch_path(spark, "cli-gl"), scratch_path(spark, "cli-out")
    gl.select(*[gl[c].cast("string") for c in gl.columns]).write.option("header", True) \
      .option("escape", '"').csv(src)
    assert main(["review", "--csv", src, "--entity-type", "Private for-profit", "--benchmark", "2000000",
                 "--sensitivity", "Balanced (0.05)", "--period-start", "1996-01-01",
                 "--period-end", "2001-10-31", "--out", out, "--memos", "5"]) == 0
    line = capsys.readouterr().out.strip().splitlines()[-1]
    info = json.loads(line)
    assert info["request"]["row_count"] == 6000 and info["materiality"]["transaction"] == 64000.0
    tables = read_packet(spark, out)
    tallies = tables["memo_tallies"].first()
    assert tallies["top_n_used"] == 5 and tallies["n_fallback"] == 5
    assert tables["flagged_queue"].count() == info["summary"]["flagged"]
    status = {(r.part, r.name): r.value for r in tables["request_and_models"].collect()}
    assert status["request", "row_count"] == "6000" and status["forest", "trees"] == "200" and status["similarity", "status"] == "trained"
    assert tables["materiality"].count() == 3 and tables["mapping_broken_codes"].count() == 1

"""The registered queries against their SQL, in a process of their own."""

import re
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
# Queries of the optional package that SQL can't say; its own tests compare them.
NO_SQL = {"op1_fingerprints", "op5_line_crf", "op7_byte_bpe", "op8_toxicity", "op11_token_alignment", "op12_whitening", "pipeline"}
DATA = Path("/root/testdata/sf0.001")


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(entry.queries()) - set(entry.oracle_sql()) == {
        "release_payload_table", "release_payload_texts", *NO_SQL & set(entry.queries()),
    }


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_queries_match_their_sql():
    run = subprocess.run([sys.executable, "-m", "checks.compare", str(DATA)], cwd=ROOT, capture_output=True, text=True, timeout=1500)
    bad = [line for line in run.stdout.splitlines() if re.search(r"\bBAD\b", line)]
    assert run.returncode == 0 and not bad, (bad, run.stderr[-500:])

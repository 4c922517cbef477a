"""Memory of Python workers: batches of bounded size, and none of what a task freed is kept."""

import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docframe.llm import ngram_jaccard, packing, quality_rules
from docframe.llm.common import BATCH_BYTES
from docframe.llm.queries import tokenizer_path

ROWS = 3000
STEPS = {
    "quality_rules": lambda d: quality_rules.quality_rules(d),
    "near_components": lambda d: ngram_jaccard.near_components(d),
    "token_pieces": lambda d: packing.token_pieces(d, tokenizer_path("byte_bpe_50k.json")),
}


def sizes(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])


@pytest.mark.parametrize("step", STEPS)
def test_batches_are_bounded(spark, step):
    own = spark.newSession()
    few = own.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    STEPS[step](few)
    texts = own.range(ROWS, numPartitions=1).select(F.repeat(F.lit("abcdefghi "), 1000).alias("text"))
    found = texts.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r["n"] for r in found) == ROWS
    assert max(r["size"] for r in found) < 1.5 * BATCH_BYTES


def test_a_size_of_the_session_stays(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1000000")
    quality_rules.quality_rules(own.createDataFrame([(1, "a")], "doc_id long, text string"))
    assert own.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1000000"


WORKER = """
import re
from pathlib import Path
from docframe.llm.common import frugal

held = lambda: int(re.search(r"Pss_Anon:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) // 1024

def work(batches):
    for b in batches:
        lists = [bytes(1000) for _ in range(100_000)]
        last = [bytes(1000)]  # stands above all of them
        del lists
        yield b, last

before = held()
pins = [x[1] for x in WRAP(work)(iter(range(2)))]
print(held() - before)
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_freed_memory_goes_back():
    kept = {w: int(subprocess.run([sys.executable, "-c", WORKER.replace("WRAP", w)], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2]).stdout) for w in ("frugal", "(lambda f: f)")}
    assert kept["frugal"] < 30 < 60 < kept["(lambda f: f)"]

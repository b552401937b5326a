"""What a Python worker keeps when its task is over, for Spark keeps the worker."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

IDLE = r"""
import re
import numpy as np, pandas, pyarrow as pa, public_tokenizers
from cairn.llm.bpe import encode_documents

class Taken:  # stands for a DataFrame: takes the function that a worker would get
    class sparkSession:
        class conf:
            set = staticmethod(lambda *_: None)
    schema, columns = [], ["text"]
    def select(self, *_): return self
    def mapInArrow(self, run, schema): return run

def held():
    return int(re.search(r"RssAnon:\s+(\d+)", open("/proc/self/status").read())[1]) / 1024

def texts(seed):
    letters = np.random.default_rng(seed).integers(97, 123, (1000, 30, 7), np.uint8)
    return pa.array([" ".join(bytes(word).decode() for word in row) for row in letters.tolist()])

import cairn.llm.bpe as bpe
bpe.F.col = lambda name: type("Column", (), {"alias": lambda *_: None})()
run = encode_documents(Taken(), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=[])
for _ in run(iter([pa.record_batch([texts(-0)], names=["_text"])])): pass
before = held()
n = sum(b.num_rows for b in run(pa.record_batch([texts(seed)], names=["_text"]) for seed in range(1, 15)))
assert n == 14_000
print(held() - before)
"""


@pytest.mark.skipif(not Path("/proc/self/status").exists(), reason="memory can't be read here")
def test_an_idle_worker_holds_little():
    """After 400,000 different words, which a cache of the tokenizer could hold all."""
    env = os.environ | {"PYTHONPATH": os.pathsep.join([str(Path(__file__).parents[2]), os.environ.get("PYTHONPATH", "")])}
    done = subprocess.run([sys.executable, "-c", IDLE], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    assert float(done.stdout.split()[-1]) < 40

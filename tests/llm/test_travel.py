"""Task functions and broadcasts need no copy of the package on the executors."""

import os
import subprocess
import sys

CODE = """
import sys
sys.path.insert(0, sys.argv[1])
from ebbtide.session import local_session
from ebbtide.llm.queries import QUERIES
spark = local_session(4, "travel", "4g")
for key in ("op1_language", "op3_bpe", "op4_suffix_dedup", "op7_decontaminate", "op10_block_dedup"):
    assert QUERIES[key](spark, sys.argv[2]).count() > 0
    QUERIES[key](spark, sys.argv[2]).write.format("noop").mode("overwrite").save()
print("travelled")
"""


def test_from_another_folder(tmp_path, sf_dir):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE, root, sf_dir], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "travelled" in done.stdout, done.stderr[-2000:]

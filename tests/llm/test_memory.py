"""What a reused worker keeps once a task is over."""

import subprocess
import sys

from refloom.llm.bpe import RUN_CHARS, Encoder
from tests.llm.test_edges import TEXTS, WORD, WORDS

#: A worker's process that encodes eight batches of 4 MB, as the packing stage has them, and prints the MB it has before and after.
TASK = """
import gc, random, sys
import pyarrow as pa
import pyspark
from refloom.llm import packing

class Context:
    get = staticmethod(lambda: type("Context", (), {"partitionId": staticmethod(lambda: 0)}))

pyspark.TaskContext = Context

def resident():
    return int(open("/proc/self/statm").read().split()[1]) * 4096 >> 20

def batches():
    r = random.Random(1)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 9))) for _ in range(60_000)]
    for k in range(8):
        texts = [" ".join(r.choices(words, k=300)) for _ in range(2000)]
        stream = pa.BufferOutputStream()
        batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(2000), pa.int64()), "content": pa.array(texts)})
        with pa.ipc.new_stream(stream, batch.schema) as w:
            w.write_batch(batch)
        del texts
        yield pa.ipc.open_stream(stream.getvalue()).read_next_batch()

run = packing._encode(sys.argv[1], 1)
list(b.num_rows for b in run([pa.RecordBatch.from_pydict({"doc_id": pa.array([1]), "content": pa.array(["a"])})]))
before = resident()
print(sum(b.num_rows for b in run(batches())), before, resident())
"""


def test_a_worker_hands_back_what_a_task_has_freed():
    done = subprocess.run([sys.executable, "-c", TASK, WORD], capture_output=True, text=True, check=True)
    rows, before, after = map(int, done.stdout.split()[-3:])
    assert rows == 16_000
    assert after - before < 60


def test_runs_of_texts_change_no_ids():
    texts = [t or "" for t in TEXTS] + [" ".join(WORDS) * (2 * RUN_CHARS // sum(map(len, WORDS))), "", *(" ".join(WORDS[k : k + 90]) for k in range(200)), ""]
    assert sum(map(len, texts)) > 2 * RUN_CHARS
    encoder = Encoder(WORD)
    assert encoder.encode(texts) == [Encoder._direct(encoder, [t])[0] for t in texts]
    assert encoder.encode([]) == []

"""The trie's budget holds for the memory of its process, also where texts are short."""

import os
import subprocess
import sys

CODE = """
import hashlib, sys
sys.path.insert(0, sys.argv[1])
from marlstone.llm import trie_dedup
trie, budget, settled, elsewhere = trie_dedup.Patricia(True), 16 << 20, 0, 0
resident = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096
before = most = resident()
for i in range(400_000):
    if i % 2_000 == 0:
        most = max(most, resident())
    if not trie.insert(hashlib.sha256(b"%d" % i).digest()[:24], i, 1):
        elsewhere += 1
    elif trie.memory > budget:
        elsewhere += sum(1 for _ in trie.spill(budget // 2))
settled = sum(1 for _ in trie.drain())
assert settled + elsewhere == 400_000 and settled > 10_000, (settled, elsewhere)
assert trie.memory == 0, trie.memory
print(most - before)
"""


def test_many_short_texts_stay_within_the_budget():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    most = int(subprocess.run([sys.executable, "-c", CODE, root], capture_output=True, text=True, check=True).stdout)
    assert 8 << 20 < most < 24 << 20, most

"""The tokenizers library over distinct runs of text, remembered per Python worker."""

from __future__ import annotations

import os
from array import array

import numpy as np

#: Inside of a character class: Unicode White_Space.
WHITE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Marks that end a run of letters, open no contraction and combine with nothing.
_TAIL = ".,;:!?*%&#$|"
_BATCH = 4096


class RunEncoder:
    """Ids of a sequence of runs that the tokenizer never merges across.

    A run of letters followed by marks is two pieces to the split patterns, so
    letters and marks are encoded, and remembered, on their own.
    """

    def __init__(self, tokenizer, *, cache_runs: int, cache_cores: int):
        """``cache_runs``, ``cache_cores``: runs and letter cores remembered before starting afresh."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs one worker per core
        self._batch = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        self._limits = cache_runs, cache_cores
        self._known: dict[str, bytes] = {}
        self._cores: dict[str, bytes] = {}

    def forget(self) -> None:
        """Give the memory back: a worker outlives its task, and the next one may be of another operator."""
        self._known.clear()
        self._cores.clear()

    def core_key(self, core: str) -> str:
        """What a run of letters is remembered under."""
        return core

    def encode_each(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece."""
        return [array("I", e.ids).tobytes() for e in self._batch(pieces, add_special_tokens=False)]

    def encode_runs(self, runs: list[str]) -> np.ndarray:
        found = list(map(self._known.get, runs))
        if None in found:
            at = [i for i, ids in enumerate(found) if ids is None]
            missing = list(dict.fromkeys([runs[i] for i in at]))
            if len(self._known) + len(missing) > self._limits[0]:
                self._known.clear()
            self._learn(missing)
            for i in at:
                found[i] = self._known[runs[i]]
        return np.frombuffer(b"".join(found), dtype="<u4")

    def _learn(self, missing: list[str]) -> None:
        cores, pieces = self._cores, []
        for r in missing:
            core = r if r.isalpha() else r.rstrip(_TAIL)
            if core.isalpha() or core[:1] == " " and core[1:].isalpha():
                pieces.append((self.core_key(core), r[len(core) :]))
            else:
                pieces.append((r, ""))
        if len(cores) > self._limits[1]:
            cores.clear()
        new = list(dict.fromkeys(p for pair in pieces for p in pair if p and p not in cores))
        for at in range(0, len(new), _BATCH):
            part = new[at : at + _BATCH]
            cores.update(zip(part, self.encode_each(part), strict=True))
        for r, (core, tail) in zip(missing, pieces, strict=True):
            self._known[r] = cores[core] + cores[tail] if tail else cores[core]

"""Embedders by name: the hashing one, and any text-to-vector callable that a caller registers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from anamnesis.functions.constants import VECTOR_FLOOR, VECTOR_STRONG

Encode = Callable[[Sequence[str]], Sequence[Sequence[float]]]


@dataclass(frozen=True)
class Embedder:
    """encode turns texts into unit vectors of one length, `batch` texts at a time and `chars` characters of each; None is the
    hashing embedder. floor and strong: the cosine from which a hit counts, and from which it counts in full."""

    name: str = "hashing-256"
    encode: Encode | None = None
    floor: float = VECTOR_FLOOR
    strong: float = VECTOR_STRONG
    batch: int = 64
    chars: int = 8000

    def batched(self) -> Callable[[list], list] | None:
        """encode over a list of any length, each distinct text once; an empty or null text is a null vector."""
        if self.encode is None:
            return None
        encode, size, chars = self.encode, self.batch, self.chars

        def all_of(texts: list) -> list:
            distinct = list(dict.fromkeys(t[:chars] for t in texts if t))
            known: dict[str, list[float]] = {}
            for i in range(0, len(distinct), size):
                part = distinct[i : i + size]
                known |= {t: [float(x) for x in v] for t, v in zip(part, encode(part), strict=True)}
            return [known[t[:chars]] if t else None for t in texts]

        return all_of


class Embedders:
    """The embedders of a process. The first that works of a caller's list becomes the current one."""

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self._by_name = {"hashing-256": Embedder()}
        self._current = "hashing-256"

    def register(self, embedder: Embedder) -> None:
        self._by_name[embedder.name] = embedder

    def names(self) -> list[str]:
        return sorted(self._by_name)

    def get(self, name: str | None = None) -> Embedder:
        return self._by_name[name or self._current]

    def use(self, *names: str) -> Embedder:
        """Makes the first of names current that is registered and gives a vector; else the hashing embedder."""
        for name in names:
            found = self._by_name.get(name)
            if found is not None and _works(found):
                self._current = name
                return found
        self._current = "hashing-256"
        return self.get()


def _works(embedder: Embedder) -> bool:
    if embedder.encode is None:
        return True
    try:
        return len(embedder.encode(["probe"])[0]) > 0
    except Exception:  # one that cannot be reached is passed over
        return False


registry = Embedders()

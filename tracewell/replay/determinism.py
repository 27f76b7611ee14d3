"""What a run pins of its randomness, and the state of the generators that it may use."""

from __future__ import annotations

import json
import os
import random

import numpy as np

MODES = ("strict", "best-effort", "off")
#: Settings that leave a matrix product to one thread, so that its sums have one order; fixed names.
THREADS = ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS")


def pin(mode: str, seed: int) -> dict:
    """Seeds the generators of the process and tells what is pinned.

    strict refuses an environment that asks for several threads in a matrix product; best-effort warns of it; off pins no threads."""
    if mode not in MODES or not 0 <= seed < 1 << 63:
        raise ValueError("a determinism mode is strict, best-effort or off, with a seed of 63 bits")
    random.seed(seed)
    np.random.seed(seed % (1 << 32))  # noqa: NPY002  the process-wide generator is what is pinned
    several = [n for n in THREADS if os.environ.get(n, "1") != "1"]
    if mode == "strict" and several:
        raise RuntimeError(f"strict determinism needs one thread in {', '.join(several)}")
    if mode != "off":
        for n in THREADS:
            os.environ.setdefault(n, "1")
    warnings = [f"{n} asks for several threads" for n in several] if mode == "best-effort" else []
    return {"mode": mode, "seed": seed, "threads": {n: os.environ.get(n) for n in THREADS}, "warnings": warnings}


def capture(**generators: np.random.Generator) -> str:
    """The state of Python's and NumPy's process-wide generators and of named ones, as JSON."""
    version, numbers, gauss = random.getstate()
    name, keys, at, has, cached = np.random.get_state()  # noqa: NPY002
    own = {n: g.bit_generator.state for n, g in generators.items()}
    return json.dumps({"python": [version, list(numbers), gauss], "numpy": [name, keys.tolist(), at, has, cached], "generators": own}, sort_keys=True)


def restore(state: str, **generators: np.random.Generator) -> None:
    """Puts a captured state back; the named generators must be those that were captured."""
    value = json.loads(state)
    if set(value["generators"]) != set(generators):
        raise ValueError(f"generators {sorted(set(value['generators']) ^ set(generators))}")
    version, numbers, gauss = value["python"]
    name, keys, at, has, cached = value["numpy"]
    random.setstate((version, tuple(numbers), gauss))
    np.random.set_state((name, np.array(keys, np.uint32), at, has, cached))  # noqa: NPY002
    for n, g in generators.items():
        if g.bit_generator.state["bit_generator"] != value["generators"][n]["bit_generator"]:
            raise ValueError(f"generator {n} is of another kind")
        g.bit_generator.state = value["generators"][n]

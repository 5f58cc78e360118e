"""Files of named arrays in the shared folder, memory-mapped by workers."""

from __future__ import annotations

import atexit
import hashlib
import json
import mmap
import os
import shutil
import tempfile

import numpy as np
from pyspark import TaskContext

from .store import opened


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    """A header with names, types and places, then the arrays at multiples of 8."""
    places, at = {}, 0
    for name, a in arrays.items():
        places[name] = [a.dtype.str, len(a), at]
        at += -(-a.nbytes // 8) * 8
    head = json.dumps(places).encode()
    head += b" " * (-(len(head) + 8) % 8)
    return b"".join([len(head).to_bytes(8, "little"), head, *(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays.values())])


def write(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Writes under a name of the attempt, then moves it, so that a retried task is safe."""
    fs, root = opened(folder)
    fs.create_dir(root, recursive=True)
    context = TaskContext.get()
    own = f"{root}/_{name}.{context.taskAttemptId() if context else 0}"
    with fs.open_output_stream(own) as out:
        out.write(packed(arrays))
    fs.move(own, f"{root}/{name}")


def mapped(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file as views of a memory map. A file that is not on a mounted path is copied
    once a machine to the temporary folder, whichever worker comes first; a worker that ends removes
    the name, which leaves the maps of the others whole."""
    fs, root = opened(folder)
    path = f"{root}/{name}"
    local = os.path.join(tempfile.gettempdir(), "panelspark-" + hashlib.sha256(path.encode()).hexdigest()[:32])
    while True:
        try:
            with open(path if os.path.exists(path) else local, "rb") as f:
                view = mmap.mmap(f.fileno(), 0, prot=mmap.PROT_READ)
            break
        except FileNotFoundError:
            with fs.open_input_stream(path) as source, tempfile.NamedTemporaryFile(delete=False) as own:
                shutil.copyfileobj(source, own, 1 << 20)
            os.replace(own.name, local)
            atexit.register(lambda: os.path.exists(local) and os.unlink(local))
    size = int.from_bytes(view[:8], "little")
    places = json.loads(view[8 : 8 + size])
    return {k: np.frombuffer(view, np.dtype(t), n, 8 + size + at) for k, (t, n, at) in places.items()}

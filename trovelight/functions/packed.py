"""Lists of whole numbers as binary values, in as few bytes a number as the largest of a list needs."""

import numpy as np
import pyarrow as pa


def bytes_needed(largest: np.ndarray) -> np.ndarray:
    """1, 2, 4 or 8: the bytes that numbers from 0 up to these take."""
    return np.select([largest <= 0xFF, largest <= 0xFFFF, largest <= 0xFFFFFFFF], [1, 2, 4], 8)


def packed(numbers: np.ndarray, widths: np.ndarray, firsts: np.ndarray) -> pa.Array:
    """Numbers in as many little-endian bytes each as `widths` tells, a binary value from each of `firsts` on."""
    every = np.ascontiguousarray(numbers, "<i8").view(np.uint8).reshape(-1, 8)
    kept = every[np.arange(8) < widths[:, None]]
    offsets = np.concatenate([[0], np.cumsum(np.add.reduceat(widths, firsts))]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(firsts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])


def pack(numbers: np.ndarray, firsts: np.ndarray) -> pa.Array:
    """Numbers from 0 on, a binary value from each of `firsts` on; none of the lists is empty."""
    widths = bytes_needed(np.maximum.reduceat(numbers, firsts))
    return packed(numbers, np.repeat(widths, np.diff(firsts, append=len(numbers))), firsts)


def pack_ids(numbers: np.ndarray, firsts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Any numbers: the lowest of each list, and how much higher the others are."""
    lowest = np.minimum.reduceat(numbers, firsts)
    return pa.array(lowest), pack(numbers - np.repeat(lowest, np.diff(firsts, append=len(numbers))), firsts)


def unpack(values: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all values of `pack`, value after value; `sizes` tells how many each holds."""
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = np.frombuffer(values.buffers()[2], np.uint8)
    widths = np.repeat(np.diff(offsets) // sizes, sizes)
    at = np.repeat(offsets[:-1], sizes) + widths * (np.arange(len(widths)) - np.repeat(np.cumsum(sizes) - sizes, sizes))
    numbers = np.zeros(len(widths), np.int64)
    for byte in range(int(widths.max(initial=0))):
        wide = np.flatnonzero(widths > byte) if byte else slice(None)
        numbers[wide] |= data[at[wide] + byte].astype(np.int64) << (8 * byte)
    return numbers


def unpack_ids(lowest: pa.Array, values: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all values of `pack_ids`."""
    return unpack(values, sizes) + np.repeat(lowest.to_numpy(), sizes)

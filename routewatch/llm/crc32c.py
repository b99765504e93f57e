"""CRC-32C over many byte ranges at once with numpy, and the mask that record files put on it."""

import numpy as np

#: The reflected Castagnoli polynomial and the mask of record files.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
BLOCK = 128


def _bytes_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


_ONE = _bytes_table()
#: _STEP[k][b]: the state after byte b and k zero bytes.
_STEP = [_ONE]
for _ in range(3):
    _STEP.append(_STEP[-1] >> 8 ^ _ONE[_STEP[-1] & 255])


def _apply(table, state):
    return table[0][state & 255] ^ table[1][state >> 8 & 255] ^ table[2][state >> 16 & 255] ^ table[3][state >> 24]


def _zeros(doublings: int) -> list[np.ndarray]:
    """For each k: four byte tables that carry a state over 2^k zero bytes."""
    lanes = [np.arange(256, dtype=np.uint32) << (8 * i) for i in range(4)]
    table = np.array([x >> 8 ^ _ONE[x & 255] for x in lanes])
    out = [table]
    for _ in range(doublings - 1):
        out.append(_apply(out[-1], out[-1]))
    return out


_ZEROS = _zeros(40)


def _over_zeros(state, n):
    """States carried over n zero bytes each."""
    for k in range(int(n.max(initial=0)).bit_length()):
        there = (n >> k & 1).astype(bool)
        state[there] = _apply(_ZEROS[k], state[there])
    return state


def crc32c(parts: list[bytes]) -> np.ndarray:
    """The CRC-32C of each part.

    Parts are padded in front to whole blocks (leading zeros leave a zero state as it is), all blocks
    are walked side by side, and each block's state is carried over the bytes behind it.
    """
    sizes = np.array([len(p) for p in parts], np.int64)
    blocks = np.maximum(1, -(-sizes // BLOCK))
    data = np.frombuffer(b"".join(p.rjust(n, b"\0") for p, n in zip(parts, (blocks * BLOCK).tolist())), "<u4").reshape(-1, BLOCK // 4)
    state = np.zeros(len(data), np.uint32)
    for column in range(BLOCK // 4):
        state = _apply(_STEP[::-1], state ^ data[:, column])
    first = np.cumsum(blocks) - blocks
    behind = np.repeat(first + blocks, blocks) - np.arange(len(data)) - 1
    states = np.bitwise_xor.reduceat(_over_zeros(state, behind * BLOCK), first) if len(parts) else state
    start = _over_zeros(np.full(len(parts), 0xFFFFFFFF, np.uint32), sizes)
    return states ^ start ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return (crc >> 15 | crc << 17) + np.uint32(MASK)

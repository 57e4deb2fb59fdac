"""Distribution documents: a scrambled key record, then a body in AES-128, blocks by themselves; all blocks are handled at once."""

from __future__ import annotations

import struct

import numpy as np

from .records import inflate

# Fixed value: the tag of the key record.
KEY_RECORD = 0x1C


def _boxes() -> tuple[np.ndarray, np.ndarray]:
    """The substitution of the cipher and its inverse: inversion in GF(256), then the affine map."""
    box = np.zeros(256, np.uint8)
    p = q = 1
    while True:
        p = p ^ (p << 1 & 0xFF) ^ (0x1B if p & 0x80 else 0)
        for s in (1, 2, 4):
            q = (q ^ q << s) & 0xFF
        q ^= 0x09 if q & 0x80 else 0
        turned = [((q << r | q >> 8 - r) & 0xFF) for r in range(5)]
        box[p] = turned[0] ^ turned[1] ^ turned[2] ^ turned[3] ^ turned[4] ^ 0x63
        if p == 1:
            break
    box[0] = 0x63
    inverse = np.zeros(256, np.uint8)
    inverse[box] = np.arange(256, dtype=np.uint8)
    return box, inverse


BOX, INVERSE = _boxes()
_ROWS = np.array([(4 * ((i // 4 + i % 4) % 4) + i % 4) for i in range(16)])


def _times(x: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros_like(x)
    while k:
        if k & 1:
            out = out ^ x
        x = (x << 1) ^ np.where(x & 0x80, 0x1B, 0).astype(np.uint8)
        k >>= 1
    return out


def _mix(state: np.ndarray, coefficients: tuple[int, int, int, int]) -> np.ndarray:
    columns = state.reshape(-1, 4, 4)
    parts = [_times(columns, k) for k in coefficients]
    out = np.zeros_like(columns)
    for row in range(4):
        for j in range(4):
            out[:, :, row] ^= parts[(j - row) % 4][:, :, j]
    return out.reshape(-1, 16)


def round_keys(key: bytes) -> np.ndarray:
    words, power = [np.frombuffer(key, np.uint8)[i : i + 4] for i in range(0, 16, 4)], 1
    while len(words) < 44:
        last = words[-1]
        if len(words) % 4 == 0:
            last = BOX[np.roll(last, -1)] ^ np.array([power, 0, 0, 0], np.uint8)
            power = power << 1 ^ (0x11B if power & 0x80 else 0)
        words.append(words[-4] ^ last)
    return np.concatenate(words).reshape(11, 16)


def encrypt(key: bytes, data: bytes) -> bytes:
    keys = round_keys(key)
    state = np.frombuffer(data, np.uint8).reshape(-1, 16) ^ keys[0]
    for i in range(1, 11):
        state = BOX[state][:, _ROWS]
        state = (state if i == 10 else _mix(state, (2, 3, 1, 1))) ^ keys[i]
    return state.astype(np.uint8).tobytes()


def decrypt(key: bytes, data: bytes) -> bytes:
    keys, back = round_keys(key), np.argsort(_ROWS)
    state = np.frombuffer(data, np.uint8).reshape(-1, 16) ^ keys[10]
    for i in range(9, -1, -1):
        state = INVERSE[state[:, back]] ^ keys[i]
        state = state if i == 0 else _mix(state, (14, 11, 13, 9))
    return state.astype(np.uint8).tobytes()


def scramble(payload: bytes) -> bytes:
    """XOR of the bytes after the seed with runs of a linear congruential generator; its own inverse."""
    x = struct.unpack_from("<I", payload)[0]
    mask = bytearray()
    while len(mask) < len(payload):
        pair = []
        for _ in range(2):
            x = (x * 214013 + 2531011) & 0xFFFFFFFF
            pair.append(x >> 16 & 0x7FFF)
        mask += bytes([pair[0] & 0xFF]) * ((pair[1] & 0xF) + 1)
    return payload[:4] + bytes(a ^ b for a, b in zip(payload[4:], mask[4 : len(payload)], strict=True))


def open_section(raw: bytes, compressed: bool = True) -> bytes:
    """Record stream of a protected section; raises ValueError on what is no such section."""
    if len(raw) < 260:
        raise ValueError("section is cut off")
    head = struct.unpack_from("<I", raw)[0]
    if head & 0x3FF != KEY_RECORD or head >> 20 != 256:
        raise ValueError("no key record")
    payload = scramble(raw[4:260])
    at = 4 + (payload[0] & 0xF)
    body = raw[260:]
    if not body or len(body) % 16:
        raise ValueError("body is no whole number of blocks")
    plain = decrypt(payload[at : at + 16], body)
    return inflate(plain) if compressed else plain


def seal_section(stream: bytes, seed: int, digest_hex: str) -> bytes:
    """A protected section of a deflated record stream; the counterpart of open_section, for tests and fixtures."""
    at = 4 + (seed & 0xF)
    text = digest_hex.encode("utf-16-le")
    payload = struct.pack("<I", seed) + bytes(at - 4) + text
    payload += bytes(256 - len(payload))
    return struct.pack("<I", KEY_RECORD | 256 << 20) + scramble(payload) + encrypt(text[:16], stream + bytes(-len(stream) % 16))

"""The published 64-bit Mersenne twister (Nishimura, 2000), for reproducible sampling."""

from __future__ import annotations

#: Fixed values of the generator's definition.
N, M = 312, 156
MATRIX, UPPER, LOWER = 0xB5026F5AA96619E9, 0xFFFFFFFF80000000, 0x7FFFFFFF
INIT = 6364136223846793005
ALL = (1 << 64) - 1


def stream(seed: int):
    """Endless 64-bit numbers."""
    state = [seed & ALL]
    for i in range(1, N):
        state.append((INIT * (state[-1] ^ (state[-1] >> 62)) + i) & ALL)
    while True:
        for i in range(N):
            x = (state[i] & UPPER) | (state[(i + 1) % N] & LOWER)
            state[i] = state[(i + M) % N] ^ (x >> 1) ^ (MATRIX if x & 1 else 0)
        for x in state:
            x ^= (x >> 29) & 0x5555555555555555
            x ^= (x << 17) & 0x71D67FFFEDA60000
            x ^= (x << 37) & 0xFFF7EEE000000000
            yield x ^ (x >> 43)


def uniform_pairs(n: int, seed: int = 0) -> list[tuple[float, float]]:
    """n pairs in [0, 1), first and second drawn in turn."""
    numbers = stream(seed)
    unit = lambda: min(next(numbers) / 2.0**64, 1 - 2.0**-53)
    return [(unit(), unit()) for _ in range(n)]

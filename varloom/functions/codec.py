"""The 2-bit genotype codec: 0/1/2 is a dosage, 3 is missing; sample 0 is in a byte's high bits."""

from __future__ import annotations

import numpy as np

MISSING = 3
#: The four codes of each byte value.
DECODE = np.stack([(np.arange(256) >> s) & 3 for s in (6, 4, 2, 0)], axis=1).astype(np.uint8)
#: How often each code occurs in each byte value.
COUNTS = np.stack([(DECODE == k).sum(1) for k in range(4)], axis=1).astype(np.int64)


def width(n_samples: int) -> int:
    return (n_samples + 3) // 4


def pack(codes: np.ndarray) -> np.ndarray:
    """Codes (..., n) to bytes (..., ceil(n / 4)); unused low bits are zero."""
    c = np.asarray(codes, np.uint8)
    pad = -c.shape[-1] % 4
    if pad:
        c = np.concatenate([c, np.zeros((*c.shape[:-1], pad), np.uint8)], axis=-1)
    q = c.reshape(*c.shape[:-1], -1, 4)
    return (q[..., 0] << 6 | q[..., 1] << 4 | q[..., 2] << 2 | q[..., 3]).astype(np.uint8)


def unpack(raw: np.ndarray, n_samples: int) -> np.ndarray:
    """Bytes (..., width) to codes (..., n_samples)."""
    b = np.asarray(raw, np.uint8)
    return DECODE[b].reshape(*b.shape[:-1], -1)[..., :n_samples]


def codes_of(dosage: np.ndarray) -> np.ndarray:
    """Dosages to codes: values that are not finite or outside 0 to 2 are missing, others are rounded."""
    d = np.asarray(dosage, float)
    ok = np.isfinite(d) & (d >= 0) & (d <= 2)
    return np.where(ok, np.rint(np.where(ok, d, 0)), MISSING).astype(np.uint8)


def counts(raw: np.ndarray, n_samples: int) -> np.ndarray:
    """Counts of the codes 0, 1, 2, 3 of each packed row, without unpacking."""
    out = COUNTS[np.asarray(raw, np.uint8)].sum(axis=-2)
    out[..., 0] -= -n_samples % 4  # the padding reads as code 0
    return out


def variant_stats(dosage: np.ndarray) -> tuple[float, float, float, bool]:
    """mu, sxx, maf over the valid values, and whether any value is missing."""
    d = np.asarray(dosage, float)
    v = d[np.isfinite(d) & (d >= 0) & (d <= 2)]
    if not len(v):
        return 0.0, 0.0, 0.0, bool(len(d))
    mu = float(v.mean())
    return mu, float(((v - mu) ** 2).sum()), min(mu / 2, 1 - mu / 2), len(v) < len(d)


def stats_of_counts(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """mu, sxx, maf from code counts (..., 4)."""
    n = c[..., :3].sum(-1).astype(float)
    s, ss = c[..., 1] + 2.0 * c[..., 2], c[..., 1] + 4.0 * c[..., 2]
    mu = np.divide(s, n, out=np.zeros_like(n), where=n > 0)
    sxx = np.where(n > 0, np.maximum(ss - n * mu * mu, 0), 0.0)
    return mu, sxx, np.where(n > 0, np.minimum(mu / 2, 1 - mu / 2), 0.0)

"""Background removal: rolling ball, white top-hat, tubeness. Tile by tile with a halo."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame

from somatica.operators import tiles
from somatica.operators.morphology import disk
from somatica.operators.pixels import blurred


def shifted_extreme(img, offsets, lift, least: bool):
    """Least (or largest) of the image (or of each of a stack) over offsets, each value raised by ``lift`` of the offset; outside does not count."""
    import numpy as np

    h, w = img.shape[-2:]
    r = max(max(abs(a), abs(b)) for a, b in offsets)
    frame = np.pad(img, [*[(0, 0)] * (img.ndim - 2), (r, r), (r, r)], constant_values=np.inf if least else -np.inf)
    out = None
    for (dy, dx), up in zip(offsets, lift, strict=True):
        seen = frame[..., r + dy : r + dy + h, r + dx : r + dx + w] + up
        out = seen if out is None else (np.minimum if least else np.maximum)(out, seen)
    return out


def rolling_ball(px: DataFrame, radius: int, height: int | Column, width: int | Column, top: float = 255.0, tile: int = 512) -> DataFrame:
    """Value less the highest place a ball of that radius reaches below the surface, clipped to 0..``top``. What lies beyond the frame does
    not hold the ball; missing pixels count as 0. ``height`` and ``width`` are numbers, or columns of ``px``; so in all that follow."""
    offsets = disk(radius)
    lift = [radius - math.sqrt(radius * radius - a * a - b * b) for a, b in offsets]

    def work(block, inside):
        import numpy as np

        return np.clip(block - shifted_extreme(np.where(inside, block, np.inf), offsets, lift, True), 0, top)

    return tiles.filter_pixels(px, radius, work, height, width, tile)


def white_top_hat(px: DataFrame, radius: int, height: int | Column, width: int | Column, tile: int = 512) -> DataFrame:
    """Value less its opening with a disk."""
    offsets, flat = disk(radius), [0.0] * len(disk(radius))

    def work(block, inside):
        import numpy as np

        eroded = shifted_extreme(np.where(inside, block, np.inf), offsets, flat, True)
        return block - shifted_extreme(np.where(inside, eroded, -np.inf), offsets, flat, False)

    return tiles.filter_pixels(px, 2 * radius, work, height, width, tile)


#: Scales of the vessel filter.
SIGMAS = (1.0, 2.0, 3.0, 4.0, 6.0)


def ridges(block, sigma: float):
    """Scaled negative smaller eigenvalue of the Hessian of the blurred array, 0 where it is negative."""
    import numpy as np

    gy, gx = np.gradient(blurred(block, sigma), axis=(-2, -1))
    yy, yx = np.gradient(gy, axis=(-2, -1))
    xx = np.gradient(gx, axis=-1)
    return np.maximum(0.0, -sigma * sigma * ((yy + xx) / 2 - np.sqrt(((yy - xx) / 2) ** 2 + yx**2)))


def tubeness(px: DataFrame, height: int | Column, width: int | Column, sigmas: tuple[float, ...] = SIGMAS, tile: int = 512) -> DataFrame:
    """Bright ridges: the largest over scales of ``ridges``; all scales in one pass over the tiles."""
    reach = int(4.0 * max(sigmas) + 0.5) + 2

    def work(block, inside):
        import numpy as np

        return np.maximum.reduce([ridges(block, s) for s in sigmas])

    return tiles.filter_pixels(px, reach, work, height, width, tile)

"""Around training: seeded crops, epoch logs, the best checkpoint, and a pluggable scorer.

Training a network needs a deep-learning library, which Spark doesn't bring; the scorer is any function from a batch of
arrays to logits, loaded once a worker. ``UNet`` is a forward pass of the usual encoder and decoder in NumPy.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def best_checkpoint(log: DataFrame, order: str, score: str, keys: list[str] | None = None) -> DataFrame:
    """Rows that beat everything before them, strictly; the first counts too. Without a score every row is kept as latest."""
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("best_before", F.max(score).over(w)).where(F.col("best_before").isNull() | (F.col(score) > F.col("best_before")))


def epoch_log(losses: DataFrame, epoch: Column, loss: str) -> DataFrame:
    return losses.groupBy(epoch.alias("epoch")).agg(F.avg(loss).alias("train_loss"), F.count("*").alias("steps"))


def crops(positives: DataFrame, frames: DataFrame, keys: list[str], per_epoch: int, crop: int, share: float = 0.7, most: int = 4000, seed: int = 0) -> DataFrame:
    """(epoch rows) seeded crop corners: a share of them centred near a positive pixel, the rest anywhere.

    ``frames``: (keys, h, w); ``positives``: (keys, y, x), of which up to ``most`` a frame are drawn from (the feature's own cap).
    """
    rank = Window.partitionBy(*keys).orderBy(F.xxhash64(*keys, "y", "x", F.lit(seed)))
    drawn = positives.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= most)
    by_frame = drawn.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("r", "y", "x"))).alias("pos"))
    unit = lambda k: F.pmod(F.xxhash64("i", *keys, F.lit(seed * 16 + k)), F.lit(1 << 30)) / (1 << 30)
    rows = frames.join(by_frame, keys, "left").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(per_epoch - 1))))
    pick = F.get("pos", F.floor(unit(1) * F.size("pos")).cast("int"))
    near = (F.size(F.coalesce("pos", F.array().cast("array<struct<r:int,y:int,x:int>>"))) > 0) & (unit(0) < share)
    jitter = lambda k: F.floor((unit(k) - 0.5) * (crop // 2)).cast("int")
    corner = lambda centre, side, k: F.greatest(F.lit(0), F.least(side - crop, F.when(near, centre - crop // 2 + jitter(k)).otherwise(F.floor(unit(k + 2) * (side - crop + 1)).cast("int"))))
    return rows.select(*keys, "i", near.alias("positive"), corner(pick["y"], F.col("h"), 2).alias("top"), corner(pick["x"], F.col("w"), 3).alias("left"),
                       (unit(6) < 0.5).alias("flip_y"), (unit(7) < 0.5).alias("flip_x"), F.floor(unit(8) * 4).cast("int").alias("turns"), (0.85 + 0.3 * unit(9)).alias("gain"), (0.3 * unit(10) - 0.15).alias("bias"))


def scored(rows: DataFrame, values: str, load: Callable[[], Callable[[np.ndarray], np.ndarray]], batch: int = 512, name: str = "p") -> DataFrame:
    """``rows`` with sigmoid(score(values)); ``load`` runs once a worker."""
    from pyspark.ml.functions import predict_batch_udf

    def make():
        score = load()
        return lambda x: 1 / (1 + np.exp(-np.asarray(score(x), float)))

    width = rows.select(F.max(F.size(values))).first()[0] or 1
    return rows.withColumn(name, predict_batch_udf(make, return_type=T.DoubleType(), batch_size=batch, input_tensor_shapes=[[width]])(F.col(values).cast("array<double>")))


class UNet:
    """Forward pass of an encoder and decoder with skips: two 3x3 convolutions a level, pooling by 2, bilinear up, one logit."""

    def __init__(self, base: int = 32, depth: int = 4, seed: int = 0):
        r = np.random.default_rng(seed)
        widths = [base * 2**k for k in range(depth + 1)]
        conv = lambda a, b, k=3: (r.normal(0, (2 / (a * k * k)) ** 0.5, (b, a, k, k)).astype(np.float32), np.zeros(b, np.float32))
        self.down = [(conv(a, b), conv(b, b)) for a, b in zip([1, *widths[:-1]], widths, strict=True)]
        self.up = [(conv(a + b, b), conv(b, b)) for a, b in zip(widths[:0:-1], widths[-2::-1], strict=True)]
        self.head = conv(base, 1, 1)
        self.base, self.depth = base, depth
        # each normalisation's scale, shift, and the mean and variance it was left with by training
        fresh = lambda n: [np.ones(n, np.float32), np.zeros(n, np.float32), np.zeros(n, np.float32), np.ones(n, np.float32)]
        self.norms = [fresh(len(b)) for pair in [*self.down, *self.up] for _, b in pair]

    def weights(self) -> dict[str, np.ndarray]:
        """All numbers by name, for a checkpoint."""
        out = {f"{side}.{k}.{j}.{n}": x for side in ("down", "up") for k, pair in enumerate(getattr(self, side)) for j, c in enumerate(pair) for n, x in zip("wb", c, strict=True)}
        out |= {f"norm.{k}.{n}": x for k, norm in enumerate(self.norms) for n, x in zip(("scale", "shift", "mean", "variance"), norm, strict=True)}
        return out | {"head.w": self.head[0], "head.b": self.head[1], "size": np.array([self.base, self.depth], np.float32)}

    @classmethod
    def of(cls, weights: dict[str, np.ndarray]) -> UNet:
        """A network with a checkpoint's numbers; a missing or misshapen one raises."""
        base, depth = (int(x) for x in weights["size"])
        out = cls(base, depth)
        for name, x in out.weights().items():
            x[...] = np.asarray(weights[name], np.float32).reshape(x.shape)
        return out

    def parameters(self) -> int:
        """Numbers in convolutions and in the scale and shift of each one's normalisation; the head has a bias instead."""
        body = [c for pair in [*self.down, *self.up] for c in pair]
        return sum(w.size + 2 * len(b) for w, b in body) + self.head[0].size + 1

    @staticmethod
    def _conv(x: np.ndarray, weights) -> np.ndarray:
        w, b = weights
        k = w.shape[-1] // 2
        x = np.pad(x, ((0, 0), (0, 0), (k, k), (k, k)))
        view = np.lib.stride_tricks.sliding_window_view(x, w.shape[-2:], axis=(2, 3))
        return np.einsum("nchwij,ocij->nohw", view, w, optimize=True) + b[:, None, None]

    def _block(self, x, pair, norms):
        """Normalised by stored figures, so a frame's result doesn't depend on its neighbours in the batch."""
        for c, norm in zip(pair, norms, strict=True):
            scale, shift, mean, var = (v[:, None, None] for v in norm)
            x = np.maximum((self._conv(x, c) - mean) / np.sqrt(var + 1e-5) * scale + shift, 0)
        return x

    def __call__(self, stack: np.ndarray) -> np.ndarray:
        """Logits (n, h, w) of frames (n, h, w) of any size."""
        from .raster import bilinear

        n, h, w = stack.shape
        unit = 2 ** (len(self.down) - 1)
        x = np.pad(stack[:, None].astype(np.float32), ((0, 0), (0, 0), (0, -h % unit), (0, -w % unit)), mode="edge")
        skips = []
        for k, pair in enumerate(self.down):
            if k:
                x = x.reshape(*x.shape[:2], x.shape[2] // 2, 2, x.shape[3] // 2, 2).max(axis=(3, 5))
            x = self._block(x, pair, self.norms[2 * k : 2 * k + 2])
            skips.append(x)
        for k, (pair, skip) in enumerate(zip(self.up, skips[-2::-1], strict=True), len(self.down)):
            grown = np.stack([[bilinear(c, *skip.shape[2:]) for c in frame] for frame in x]).astype(np.float32)
            x = self._block(np.concatenate([skip, grown], axis=1), pair, self.norms[2 * k : 2 * k + 2])
        return self._conv(x, self.head)[:, 0, :h, :w]

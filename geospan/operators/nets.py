"""Networks over images, in array arithmetic: layers by their shapes, run in Arrow batches where weights are supplied.

A layer names its weights and their shapes, so that a network's parameters are
counted, and a checkpoint's names checked, without making any. Images are arrays
``(image, channel, row, column)``. Networks are in their evaluation mode.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Weights = dict[str, np.ndarray]


class Layer:
    """Something with named weights that turns an array into another."""

    def parts(self) -> dict[str, Layer]:
        return {}

    def own(self) -> dict[str, tuple[int, ...]]:
        """Shapes of the weights that are this layer's and learnt."""
        return {}

    def kept(self) -> dict[str, tuple[int, ...]]:
        """Shapes of what is kept but not learnt."""
        return {}

    def shapes(self, learnt: bool = False) -> dict[str, tuple[int, ...]]:
        out = self.own() | ({} if learnt else self.kept())
        for name, part in self.parts().items():
            out |= {f"{name}.{n}": s for n, s in part.shapes(learnt).items()}
        return out

    def run(self, x: np.ndarray, w: Weights, at: str = "") -> np.ndarray:
        raise NotImplementedError

    def __call__(self, x: np.ndarray, weights: Weights) -> np.ndarray:
        check(self, weights)
        return self.run(np.asarray(x, float), weights)


def count_parameters(layer: Layer) -> int:
    """Numbers that are learnt."""
    return sum(math.prod(s) for s in layer.shapes(learnt=True).values())


def key_difference(layer: Layer, weights: Weights) -> tuple[list[str], list[str]]:
    """Names that the weights lack, and names that the layer does not know."""
    wanted = layer.shapes()
    return sorted(wanted.keys() - weights.keys()), sorted(weights.keys() - wanted.keys())


def check(layer: Layer, weights: Weights) -> None:
    missing, unknown = key_difference(layer, weights)
    wrong = [n for n, s in layer.shapes().items() if n in weights and tuple(weights[n].shape) != s]
    if missing or unknown or wrong:
        raise ValueError(f"missing weights {missing}, unknown ones {unknown}, of another shape {wrong}")


def fresh(layer: Layer, seed: int = 0) -> Weights:
    """Weights by chance: normal, scaled by the root of what flows in; norms start as the identity."""
    rng = np.random.default_rng(seed)
    out = {}
    for name, s in layer.shapes().items():
        kind = name.rsplit(".", 1)[-1]
        if len(s) > 1:
            out[name] = rng.normal(0, math.sqrt(2 / math.prod(s[1:])), s)
        else:
            out[name] = np.ones(s) if kind in ("scale", "variance") else np.zeros(s)
    return out


class Conv(Layer):
    def __init__(self, into: int, out: int, size: int = 3, stride: int = 1, pad: int | None = None, bias: bool = False):
        self.into, self.out, self.size, self.stride, self.bias = into, out, size, stride, bias
        self.pad = size // 2 if pad is None else pad

    def own(self):
        return {"weight": (self.out, self.into, self.size, self.size)} | ({"bias": (self.out,)} if self.bias else {})

    def run(self, x, w, at=""):
        p, s = self.pad, self.stride
        x = np.pad(x, ((0, 0), (0, 0), (p, p), (p, p)))
        windows = np.lib.stride_tricks.sliding_window_view(x, (self.size, self.size), (2, 3))[:, :, ::s, ::s]
        y = np.einsum("nchwij,ocij->nohw", windows, w[at + "weight"], optimize=True)
        return y + w[at + "bias"][:, None, None] if self.bias else y


class Norm(Layer):
    def __init__(self, n: int):
        self.n = n

    def own(self):
        return {"scale": (self.n,), "shift": (self.n,)}

    def kept(self):
        return {"mean": (self.n,), "variance": (self.n,)}

    def run(self, x, w, at=""):
        each = lambda name: w[at + name][:, None, None]
        return (x - each("mean")) / np.sqrt(each("variance") + 1e-5) * each("scale") + each("shift")


class Linear(Layer):
    def __init__(self, into: int, out: int):
        self.into, self.out = into, out

    def own(self):
        return {"weight": (self.out, self.into), "bias": (self.out,)}

    def run(self, x, w, at=""):
        return x @ w[at + "weight"].T + w[at + "bias"]


class Plain(Layer):
    """A function without weights."""

    def __init__(self, function: Callable[[np.ndarray], np.ndarray]):
        self.function = function

    def run(self, x, w, at=""):
        return self.function(x)


RELU = Plain(lambda x: np.maximum(x, 0))
MEAN = Plain(lambda x: x.mean((2, 3)))


def pool(size: int, stride: int, pad: int = 0) -> Plain:
    def most(x: np.ndarray) -> np.ndarray:
        x = np.pad(x, ((0, 0), (0, 0), (pad, pad), (pad, pad)), constant_values=-np.inf)
        return np.lib.stride_tricks.sliding_window_view(x, (size, size), (2, 3))[:, :, ::stride, ::stride].max((4, 5))

    return Plain(most)


def to_size(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, the corners' centres kept in place."""
    for axis, m in ((2, height), (3, width)):
        n = x.shape[axis]
        place = np.arange(m) * ((n - 1) / max(m - 1, 1))
        low = np.minimum(np.floor(place).astype(int), max(n - 2, 0))
        share = (place - low).reshape([-1 if k == axis else 1 for k in range(4)])
        x = np.take(x, low, axis) * (1 - share) + np.take(x, np.minimum(low + 1, n - 1), axis) * share
    return x


class Chain(Layer):
    """Layers one after the other, named by their place or as told."""

    def __init__(self, *layers: Layer, **named: Layer):
        self.steps = {str(i): layer for i, layer in enumerate(layers)} | named

    def parts(self):
        return self.steps

    def run(self, x, w, at=""):
        for name, layer in self.steps.items():
            x = layer.run(x, w, f"{at}{name}.")
        return x


def double_conv(into: int, out: int) -> Chain:
    return Chain(Conv(into, out), Norm(out), RELU, Conv(out, out), Norm(out), RELU)


class UNet(Layer):
    """Four levels down and up; going up, what was there on the way down is put beside."""

    def __init__(self, into: int = 3, classes: int = 1, features: tuple[int, ...] = (64, 128, 256, 512)):
        f = [*features, features[-1]]
        self.inc, self.outc = double_conv(into, f[0]), Conv(f[0], classes, 1, bias=True)
        self.down = [Chain(pool(2, 2), double_conv(a, b)) for a, b in zip(f, f[1:], strict=False)]
        # Each way up ends with as many channels as the next level down has, or with the first level's.
        widths = [f[-1]]
        for i in reversed(range(len(features))):
            widths.append(f[i] // 2 if i else f[0])
        self.up = [double_conv(widths[k] + f[i], widths[k + 1]) for k, i in enumerate(reversed(range(len(features))))]

    def parts(self):
        return {"inc": self.inc} | {f"down{i + 1}": d for i, d in enumerate(self.down)} | {f"up{i + 1}": u for i, u in enumerate(self.up)} | {"outc": self.outc}

    def run(self, x, w, at=""):
        there = [self.inc.run(x, w, f"{at}inc.")]
        for i, down in enumerate(self.down):
            there.append(down.run(there[-1], w, f"{at}down{i + 1}."))
        x = there.pop()
        for i, up in enumerate(self.up):
            beside = there.pop()
            x = up.run(np.concatenate((beside, to_size(x, *beside.shape[2:])), 1), w, f"{at}up{i + 1}.")
        return self.outc.run(x, w, f"{at}outc.")


class Residual(Layer):
    """A chain whose input is added to its output, through a convolution where their shapes differ."""

    def __init__(self, chain: Chain, into: int, out: int, stride: int):
        self.chain, self.short = chain, Chain(Conv(into, out, 1, stride, 0), Norm(out)) if stride > 1 or into != out else None

    def parts(self):
        return {"chain": self.chain} | ({"short": self.short} if self.short else {})

    def run(self, x, w, at=""):
        y = self.chain.run(x, w, f"{at}chain.")
        return np.maximum(y + (self.short.run(x, w, f"{at}short.") if self.short else x), 0)


def basic_block(into: int, n: int, stride: int) -> Residual:
    return Residual(Chain(Conv(into, n, 3, stride), Norm(n), RELU, Conv(n, n), Norm(n)), into, n, stride)


def bottleneck(into: int, n: int, stride: int) -> Residual:
    return Residual(Chain(Conv(into, n, 1, pad=0), Norm(n), RELU, Conv(n, n, 3, stride), Norm(n), RELU, Conv(n, 4 * n, 1, pad=0), Norm(4 * n)), into, 4 * n, stride)


class ResNet(Layer):
    """A stem, four stages of residual blocks, and a linear layer over the mean."""

    # The block and the numbers of blocks of each published depth.
    DEPTHS = {18: (basic_block, 1, (2, 2, 2, 2)), 34: (basic_block, 1, (3, 4, 6, 3)), 50: (bottleneck, 4, (3, 4, 6, 3))}

    def __init__(self, depth: int = 18, into: int = 3, classes: int = 1000):
        block, wider, counts = self.DEPTHS[depth]
        self.stem = Chain(Conv(into, 64, 7, 2, 3), Norm(64), RELU, pool(3, 2, 1))
        self.stages, now = [], 64
        for stage, count in enumerate(counts):
            n, blocks = 64 << stage, []
            for k in range(count):
                blocks.append(block(now, n, 2 if stage and not k else 1))
                now = n * wider
            self.stages.append(Chain(*blocks))
        self.widths, self.head = [64 * wider << s for s in range(4)], Linear(now, classes)

    def parts(self):
        return {"stem": self.stem} | {f"stage{i + 1}": s for i, s in enumerate(self.stages)} | {"head": self.head}

    def features(self, x: np.ndarray, w: Weights, at: str = "") -> list[np.ndarray]:
        x, out = self.stem.run(x, w, f"{at}stem."), []
        for i, stage in enumerate(self.stages):
            x = stage.run(x, w, f"{at}stage{i + 1}.")
            out.append(x)
        return out

    def run(self, x, w, at=""):
        return self.head.run(self.features(x, w, at)[-1].mean((2, 3)), w, f"{at}head.")


class Pyramid(Layer):
    """Features of all levels with as many channels, the coarser ones added to the finer."""

    def __init__(self, widths: list[int], out: int = 256):
        self.side, self.smooth = [Conv(n, out, 1, pad=0, bias=True) for n in widths], [Conv(out, out, bias=True) for _ in widths]

    def parts(self):
        return {f"side{i}": s for i, s in enumerate(self.side)} | {f"smooth{i}": s for i, s in enumerate(self.smooth)}

    def levels(self, features: list[np.ndarray], w: Weights, at: str = "") -> list[np.ndarray]:
        out = [side.run(x, w, f"{at}side{i}.") for i, (side, x) in enumerate(zip(self.side, features, strict=True))]
        for i in reversed(range(len(out) - 1)):
            h, v = out[i].shape[2:]
            big = out[i + 1]
            out[i] = out[i] + big[:, :, (np.arange(h) * big.shape[2]) // h][:, :, :, (np.arange(v) * big.shape[3]) // v]
        return [s.run(x, w, f"{at}smooth{i}.") for i, (s, x) in enumerate(zip(self.smooth, out, strict=True))]


def segmentation_head(into: int, classes: int) -> Chain:
    return Chain(Conv(into, into, bias=True), RELU, Conv(into, classes, 1, bias=True))


def classification_head(into: int, classes: int) -> Chain:
    return Chain(MEAN, Linear(into, classes))


def detection_head(into: int, classes: int, anchors: int = 9) -> dict[str, Chain]:
    """Scores of classes, and four numbers of a box, for each anchor."""
    tower = lambda out: Chain(Conv(into, into, bias=True), RELU, Conv(into, out, bias=True))
    return {"classes": tower(anchors * classes), "boxes": tower(4 * anchors)}


def srcnn(channels: int = 3) -> Chain:
    """Three convolutions over an image that was made larger before."""
    return Chain(Conv(channels, 64, 9, bias=True), RELU, Conv(64, 32, 1, bias=True), RELU, Conv(32, channels, 5, bias=True))


class Siamese(Layer):
    """Two images through one encoder; their differences are decoded."""

    def __init__(self, into: int = 3, classes: int = 2, widths: tuple[int, ...] = (32, 64, 128)):
        sizes = [into, *widths]
        self.encoder = Chain(*(layer for a, b in zip(sizes, widths, strict=False) for layer in (double_conv(a, b), pool(2, 2))))
        self.decoder = Chain(double_conv(widths[-1], widths[0]), Conv(widths[0], classes, 1, bias=True))

    def parts(self):
        return {"encoder": self.encoder, "decoder": self.decoder}

    def run(self, x, w, at=""):
        half = x.shape[1] // 2
        a, b = (self.encoder.run(part, w, f"{at}encoder.") for part in (x[:, :half], x[:, half:]))
        return to_size(self.decoder.run(np.abs(a - b), w, f"{at}decoder."), *x.shape[2:])


def applied(df: DataFrame, layer: Layer, weights: Weights, shape: tuple[int, int, int], data: str = "data", key: str = "id", at_once: int = 16) -> DataFrame:
    """``key, shape, output`` for a column of flat images (channels, rows, columns); the weights are sent to each executor once."""
    check(layer, weights)
    sent = df.sparkSession.sparkContext.broadcast(weights)  # the size of the network

    def run(batches: Iterator):
        import pandas as pd

        for whole in batches:
            for at in range(0, len(whole), at_once):
                pdf = whole.iloc[at : at + at_once]
                out = layer.run(np.stack([np.asarray(v, float).reshape(shape) for v in pdf[data]]), sent.value)
                yield pd.DataFrame({key: pdf[key].to_numpy(), "shape": [list(out.shape[1:])] * len(pdf), "output": [o.ravel().tolist() for o in out]})

    return df.select(F.col(key).cast("long").alias(key), F.col(data).cast("array<double>").alias(data)).mapInPandas(run, f"{key} long, shape array<int>, output array<double>")

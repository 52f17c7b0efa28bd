"""Trainable models as sets of column expressions.

A model keeps one row per feature with a few weight columns. Training needs four things from it, each a
column expression, so that a whole iteration stays one relational plan:

* ``terms``: what a cell adds to the statistics of its sample (summed per slot),
* ``loss`` and ``coefs``: functions of a sample's statistics and label,
* ``sums``: what a cell adds to the gradient sums of its feature (summed per feature),
* ``gradient``: the gradient of every weight, from the feature's sums and its current weights.

Only the statistics and the coefficients, a few numbers per drawn sample, travel between slices. A model may pass over
the cells several times (``passes``, ``returns``): what one pass sums per sample, the next one sees in every cell.
A user-defined model subclasses :class:`Objective`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slicegrad.functions import scalars as S
from slicegrad.functions.hashing import gaussian


class Objective:
    """Base of all models; ``classes`` is the number of label values."""

    name = "objective"
    classes = 2

    def weights(self) -> list[str]:
        """Names of the weight columns of a feature."""
        raise NotImplementedError

    def stats(self) -> list[str]:
        """Names of the statistics of a sample."""
        raise NotImplementedError

    def initial(self, feature: Column, seed: int) -> dict[str, Column]:
        """Initial weights of a feature; zero unless overridden."""
        return {name: F.lit(0.0) for name in self.weights()}

    def terms(self) -> dict[str, Column]:
        """Per statistic: the addend of one cell, over ``value`` and the weight columns."""
        raise NotImplementedError

    def passes(self) -> list[dict[str, Column]]:
        """The terms, pass by pass; those of a later pass may refer to the statistics of the earlier ones. One pass by default."""
        return [self.terms()]

    def returns(self) -> list[dict[str, Column]]:
        """Further sums per sample on the way back from the loss, pass by pass: none by default.

        Like terms they are addends of a cell, over ``value``, the weights, and the statistics and stages of the sample so far;
        ``coefs`` may refer to them. They carry a gradient through a pass to the passes before it.
        """
        return []

    def sums_see_weights(self) -> bool:
        """Whether ``sums`` refer to the weights of the cell's feature."""
        return False

    def touched_only(self) -> bool:
        """Whether the gradient is zero where all sums are, so that a feature without cells in a batch only shrinks.

        A model may only say so if it holds; large models are then trained on the features their batches touch.
        """
        return False

    def stages(self) -> list[dict[str, Column]]:
        """Columns to add to the statistics, stage by stage, before losses, factors and scores are taken; none by default."""
        return []

    def loss(self) -> Column:
        """Loss of one sample, over ``label`` and the statistics."""
        raise NotImplementedError

    def coefs(self) -> dict[str, Column]:
        """Per-sample factors needed by ``sums``, over ``label`` and the statistics."""
        raise NotImplementedError

    def sums(self) -> dict[str, Column]:
        """Per gradient sum: the addend of one cell, over ``value`` and the coefficients."""
        raise NotImplementedError

    def gradient(self) -> dict[str, Column]:
        """Per weight: its batch gradient (a sum), over the gradient sums and the weights."""
        raise NotImplementedError

    def scores(self) -> dict[str, Column]:
        """Columns reported when a data set is scored."""
        raise NotImplementedError


class _Linear(Objective):
    """Shared part of the binary linear models: one weight per feature, one dot product per sample."""

    def touched_only(self):
        return True

    def weights(self):
        return ["w0"]

    def stats(self):
        return ["s0"]

    def terms(self):
        return {"s0": F.col("w0") * F.col("value")}

    def sums(self):
        return {"g0": F.col("c0") * F.col("value")}

    def gradient(self):
        return {"w0": F.col("g0")}


class Logistic(_Linear):
    """Binary logistic regression without intercept; labels 0 and 1."""

    name = "lr"

    def loss(self):
        return S.log1pexp(-S.signed_label(F.col("label")) * F.col("s0"))

    def coefs(self):
        return {"c0": S.logistic_coef(F.col("s0"), F.col("label"))}

    def scores(self):
        return {"score": F.col("s0"), "probability": S.sigmoid(F.col("s0"))}


class Hinge(_Linear):
    """Linear support vector machine without intercept; labels 0 and 1."""

    name = "svm"

    def loss(self):
        return F.greatest(F.lit(0.0), 1.0 - S.signed_label(F.col("label")) * F.col("s0"))

    def coefs(self):
        return {"c0": S.hinge_coef(F.col("s0"), F.col("label"))}

    def scores(self):
        return {"score": F.col("s0")}


class Softmax(Objective):
    """Multinomial logistic regression: one weight and one dot product per class."""

    name = "mlr"

    def touched_only(self):
        return True

    def __init__(self, classes: int = 2):
        self.classes = classes

    def weights(self):
        return [f"w{k}" for k in range(self.classes)]

    def stats(self):
        return [f"s{k}" for k in range(self.classes)]

    def _scores(self):
        return [F.col(name) for name in self.stats()]

    def terms(self):
        return {f"s{k}": F.col(f"w{k}") * F.col("value") for k in range(self.classes)}

    def stages(self):
        return S.softmax_stages(self.stats())

    def loss(self):
        return S.log_sum_exp() - S.pick(self._scores(), F.col("label"))

    def coefs(self):
        shares = S.softmax(self.classes)
        return {
            f"c{k}": share - F.when(F.col("label") == k, 1.0).otherwise(0.0)
            for k, share in enumerate(shares)
        }

    def sums(self):
        return {f"g{k}": F.col(f"c{k}") * F.col("value") for k in range(self.classes)}

    def gradient(self):
        return {f"w{k}": F.col(f"g{k}") for k in range(self.classes)}

    def scores(self):
        return {f"p{k}": share for k, share in enumerate(S.softmax(self.classes))}


class Factorization(Objective):
    """Degree-two factorization machine with ``factors`` factors and no global bias.

    Column ``w0`` is the linear weight, ``w1..wK`` are the factors of a feature. Statistic ``s0`` folds
    the linear part and the self-interaction ``-x^2 v^2 / 2``; ``s1..sK`` are the factor sums, so a sample
    needs K+1 numbers. The factor gradient ``sum(c x S_f) - v_f sum(c x^2)`` splits the same way, so the
    factors themselves need not be joined to the cells a second time.
    """

    name = "fm"

    def touched_only(self):
        return True

    def __init__(self, factors: int = 10):
        self.factors = factors
        self._ks = range(1, factors + 1)

    def weights(self):
        return [f"w{k}" for k in range(self.factors + 1)]

    def stats(self):
        return [f"s{k}" for k in range(self.factors + 1)]

    def initial(self, feature, seed):
        start = {"w0": F.lit(0.0)}
        start.update({f"w{k}": gaussian(seed, feature, F.lit(k)) for k in self._ks})
        return start

    def terms(self):
        x = F.col("value")
        squares = S.total([F.col(f"w{k}") * x * F.col(f"w{k}") * x for k in self._ks])
        terms = {"s0": F.col("w0") * x - 0.5 * squares}
        terms.update({f"s{k}": F.col(f"w{k}") * x for k in self._ks})
        return terms

    def score(self) -> Column:
        """Pairwise score of a sample from its statistics."""
        return F.col("s0") + 0.5 * S.total([F.col(f"s{k}") * F.col(f"s{k}") for k in self._ks])

    def loss(self):
        return S.log1pexp(-S.signed_label(F.col("label")) * self.score())

    def coefs(self):
        coef = S.logistic_coef(self.score(), F.col("label"))
        factors = {f"c{k}": coef * F.col(f"s{k}") for k in self._ks}
        return {"c0": coef, **factors}

    def sums(self):
        x = F.col("value")
        sums = {f"g{k}": F.col(f"c{k}") * x for k in range(self.factors + 1)}
        sums["gself"] = F.col("c0") * x * x
        return sums

    def gradient(self):
        gradient = {"w0": F.col("g0")}
        gradient.update({f"w{k}": F.col(f"g{k}") - F.col(f"w{k}") * F.col("gself") for k in self._ks})
        return gradient

    def scores(self):
        return {"score": self.score(), "probability": S.sigmoid(self.score())}


class Optimizer:
    """Turns a batch gradient into new weights."""

    def state(self, weights: list[str]) -> list[str]:
        """Further columns kept per weight, starting at zero."""
        return []

    def idle(self, weight: str, shrink: float, rounds: int) -> dict[str, Column]:
        """What ``rounds`` iterations without a gradient make of a weight and its state."""
        return {weight: F.col(weight) * shrink**rounds}

    def update(self, weight: str, gradient: Column, step: float, batch_size: int, shrink: float) -> dict[str, Column]:
        raise NotImplementedError


class Sgd(Optimizer):
    """Plain step. The shrink multiplies the weight before the step and is not scaled by it."""

    def update(self, weight, gradient, step, batch_size, shrink):
        return {weight: F.col(weight) * shrink - (step / batch_size) * gradient}


class Adam(Optimizer):
    """Lazy Adam: a weight whose batch gradient is exactly zero keeps its moments.

    Bias correction uses the iteration number plus one. It is read from the gradient rows (column ``t``)
    rather than written into the expression, so that every iteration compiles to the same code.
    With ``decay_moments`` the shrink also applies to both moments.
    """

    def __init__(self, beta1: float = 0.9, beta2: float = 0.99, eps: float = 1e-7, decay_moments: bool = True):
        self.beta1, self.beta2, self.eps, self.decay_moments = beta1, beta2, eps, decay_moments

    def state(self, weights):
        return [f"{kind}_{name}" for name in weights for kind in ("m", "v")]

    def idle(self, weight, shrink, rounds):
        kept = shrink**rounds if self.decay_moments else 1.0
        return {weight: F.col(weight) * shrink**rounds} | {f"{kind}_{weight}": F.col(f"{kind}_{weight}") * kept for kind in ("m", "v")}

    def update(self, weight, gradient, step, batch_size, shrink):
        kept = shrink if self.decay_moments else 1.0
        g = gradient / float(batch_size)
        w, m, v = F.col(weight) * shrink, F.col(f"m_{weight}") * kept, F.col(f"v_{weight}") * kept
        moved = gradient != 0.0
        new_m = self.beta1 * m + (1.0 - self.beta1) * g
        new_v = self.beta2 * v + (1.0 - self.beta2) * g * g
        rounds = F.col("t") + 1
        m_bias = 1.0 - F.pow(F.lit(self.beta1), rounds)
        v_bias = 1.0 - F.pow(F.lit(self.beta2), rounds)
        new_w = w - step / (F.sqrt(new_v / v_bias) + self.eps) * new_m / m_bias
        return {
            weight: F.when(moved, new_w).otherwise(w),
            f"m_{weight}": F.when(moved, new_m).otherwise(m),
            f"v_{weight}": F.when(moved, new_v).otherwise(v),
        }


def make_objective(name: str, k: int | None = None) -> Objective:
    """Objective by model name; ``k`` is the class count of ``mlr`` or the factor count of ``fm``."""
    kind = name.lower()
    if kind in ("lr", "adamlr"):
        return Logistic()
    if kind in ("svm", "adamsvm"):
        return Hinge()
    if kind == "mlr":
        return Softmax(k or 2)
    if kind == "fm":
        return Factorization(k or 10)
    raise ValueError(f"unknown model {name!r}")

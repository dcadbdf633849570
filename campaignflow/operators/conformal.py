"""Online interval calibration: adaptive conformal inference and two PID controllers, one sequence per series."""

import bisect
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METHODS = ["adaptive", "pid", "pid_learned"]
# Default controller gains.
DEFAULTS = {"alpha": 0.1, "gamma": 0.02, "ki": 0.01, "integral_clip": 5.0, "kd": 0.3, "decay": 0.9,
            "lags": 3, "ridge": 1.0, "min_history": 20, "window": None}


class Controller:
    """One series' controller: interval width correction from past scores, miscoverage level from past hits."""

    def __init__(self, method: str, **options):
        self.o = {**DEFAULTS, **options}
        self.method = method
        self.level, self.integral, self.smooth = self.o["alpha"], 0.0, 0.0
        self.scores: list[float] = []
        self.ranked: list[float] = []
        k = self.o["lags"] + 1
        self.gram, self.moment = np.zeros((k, k)), np.zeros(k)
        self.total, self.seen = 0.0, 0

    def dump(self) -> tuple:
        """Plain values of the state: what a stream keeps per key."""
        return (self.level, self.integral, self.smooth, self.total, self.seen, [float(s) for s in self.scores],
                [float(g) for g in self.gram.ravel()], [float(m) for m in self.moment])

    def load(self, state: tuple) -> "Controller":
        self.level, self.integral, self.smooth, self.total, self.seen, scores, gram, moment = state
        self.scores = list(scores)
        self.ranked = sorted(self.scores[-self.o["window"]:] if self.o["window"] else self.scores)
        self.gram, self.moment = np.array(gram).reshape(self.gram.shape), np.array(moment)
        return self

    def quantile(self, level: float) -> float:
        """Linear-interpolated quantile of the scores in view."""
        if not self.ranked:
            return 0.0
        h = (len(self.ranked) - 1) * min(max(level, 0.0), 1.0)
        low = math.floor(h)
        high = min(low + 1, len(self.ranked) - 1)
        return self.ranked[low] + (self.ranked[high] - self.ranked[low]) * (h - low)

    def remember(self, score: float) -> None:
        lags = self.o["lags"]
        if len(self.scores) >= lags:
            x = np.append(self.scores[-lags:], 1.0)
            self.gram += np.outer(x, x)
            self.moment += x * score
        self.scores.append(score)
        self.total += score
        self.seen += 1
        bisect.insort(self.ranked, score)
        window = self.o["window"]
        if window and len(self.ranked) > window:
            self.ranked.pop(bisect.bisect_left(self.ranked, self.scores[-window - 1]))

    def next_score(self) -> float:
        """Ridge autoregression of the score, from its accumulated normal equations."""
        lags = self.o["lags"]
        if len(self.scores) <= lags:
            return self.total / self.seen if self.seen else 0.0
        penalty = np.diag([self.o["ridge"]] * lags + [0.0])
        try:
            beta = np.linalg.solve(self.gram + penalty, self.moment)
        except np.linalg.LinAlgError:
            return self.scores[-1]
        return float(np.append(self.scores[-lags:], 1.0) @ beta)

    def step(self, low: float, high: float, y: float) -> tuple[float, float, float, float, bool]:
        """Interval for this step, then learn from its outcome: (level used, correction, low, high, covered)."""
        o, used = self.o, self.level
        warm = self.seen >= o["min_history"]
        fix = self.quantile(1 - self.level) if warm else 0.0
        if self.method == "pid_learned":
            ahead = o["kd"] * self.next_score() if warm and self.seen > o["lags"] else 0.0
            fix = max(fix + ahead, -(high - low) / 2.0 + 1e-6)
        a, b = low - fix, high + fix
        covered = a <= y <= b
        signal = o["alpha"] - (0.0 if covered else 1.0)
        move = o["gamma"] * signal
        if self.method != "adaptive":
            self.integral = min(max(self.integral + signal, -o["integral_clip"]), o["integral_clip"])
            move += o["ki"] * self.integral
        if self.method == "pid":
            move += o["kd"] * (signal - self.smooth)
            self.smooth = o["decay"] * self.smooth + (1 - o["decay"]) * signal
        self.level = min(max(self.level + move, 1e-6), 1 - 1e-6)
        self.remember(max(low - y, y - high))
        return used, fix, a, b, covered


STEP_SCHEMA = "series string, seq bigint, method string, level double, correction double, low double, high double, covered boolean"


def run_online(sequence: DataFrame, methods=METHODS, **options) -> DataFrame:
    """Step through every series in ``seq`` order.

    ``sequence`` has (series, seq, low, high, y) with at most one row per series and calendar step, so a
    series is bounded by the calendar however many source rows stand behind it.
    """

    def play(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        out = []
        for method in methods:
            c = Controller(method, **options)
            for seq, low, high, y in zip(pdf["seq"], pdf["low"], pdf["high"], pdf["y"]):
                out.append((pdf["series"].iloc[0], seq, method, *c.step(low, high, y)))
        return pd.DataFrame(out, columns=["series", "seq", "method", "level", "correction", "low", "high", "covered"])

    return sequence.groupBy("series").applyInPandas(play, STEP_SCHEMA)


def compare_methods(sequence: DataFrame, alpha: float = 0.1, gamma: float = 0.03, warmup: float = 0.2,
                    min_warmup: int = 20, min_scored: int = 10) -> DataFrame:
    """Coverage and mean width after the warm-up, per series and method, against one fixed correction."""

    def play(pdf: pd.DataFrame) -> pd.DataFrame:
        columns = ["series", "method", "n_scored", "coverage", "mean_width", "final_level"]
        pdf = pdf.sort_values("seq")
        n, start = len(pdf), max(min_warmup, int(len(pdf) * warmup))
        if n - start < min_scored:
            return pd.DataFrame([], columns=columns)
        name = pdf["series"].iloc[0]
        lo, hi, y = (pdf[c].to_numpy(float) for c in ("low", "high", "y"))
        scores = np.maximum(lo - y, y - hi)[:start]
        fix = float(np.quantile(scores, min(1.0, math.ceil((start + 1) * (1 - alpha)) / start)))
        a, b = np.maximum(lo[start:] - fix, 0.0), hi[start:] + fix
        rows = [(name, "static", n - start, float(((y[start:] >= a) & (y[start:] <= b)).mean()), float((b - a).mean()), alpha)]
        for method in METHODS:
            c = Controller(method, alpha=alpha, gamma=gamma, min_history=start)
            steps = [c.step(*v) for v in zip(lo, hi, y)][start:]
            rows.append((name, method, n - start, float(np.mean([s[4] for s in steps])),
                         float(np.mean([s[3] - s[2] for s in steps])), c.level))
        return pd.DataFrame(rows, columns=columns)

    return sequence.groupBy("series").applyInPandas(
        play, "series string, method string, n_scored bigint, coverage double, mean_width double, final_level double")


def summarise_methods(compared: DataFrame) -> DataFrame:
    """Row-weighted coverage and width per method over all series."""
    n = F.sum("n_scored")
    return compared.groupBy("method").agg(
        F.count(F.lit(1)).alias("n_series"), n.alias("n_scored"),
        (F.sum(F.col("coverage") * F.col("n_scored")) / n).alias("coverage"),
        (F.sum(F.col("mean_width") * F.col("n_scored")) / n).alias("mean_width"))

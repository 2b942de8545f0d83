"""Preprocessing estimators (T1-T11): fit on the training rows with one Spark
aggregate, then transform any table with column expressions.

They are ``pyspark.ml`` Estimators/Models, so they compose in a
``pyspark.ml.Pipeline`` with MLlib stages.  Fitted state is small: per-column
statistics and category lists (sizes bounded by the column count and the
category count, both checked)."""

from __future__ import annotations

import re
from itertools import combinations_with_replacement

from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.feature import PCA as _MLPCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import medians
from ..functions.ranking import global_index


def _sanitize(v: str) -> str:
    return re.sub(r"[^0-9A-Za-z_]", "_", str(v))


# --------------------------------------------------------------------- T1-T3
class Impute(Estimator):
    """Median / zero / constant imputation (T1-T3).  Medians are exact
    (``exact_quantiles``), not ``ml.feature.Imputer``'s approximate ones.
    A numeric column that is entirely null in the training rows is left out of
    the output (and listed in ``model.dropped``)."""

    def __init__(self, median=(), zero=(), constant=None):
        super().__init__()
        self.median, self.zero, self.constant = list(median), list(zero), dict(constant or {})

    def _fit(self, df: DataFrame) -> "ImputeModel":
        med = medians(df, [c for c in self.median if c in df.columns])
        dropped = [c for c, v in med.items() if v is None]
        fills = {c: float(v) for c, v in med.items() if v is not None}
        fills.update({c: 0.0 for c in self.zero if c in df.columns})
        return ImputeModel(fills, {c: v for c, v in self.constant.items() if c in df.columns}, dropped)


class ImputeModel(Model):
    def __init__(self, fills: dict, constants: dict, dropped: list):
        super().__init__()
        self.fills, self.constants, self.dropped = fills, constants, dropped

    def _transform(self, df: DataFrame) -> DataFrame:
        # NaN is a missing number, like null
        cols = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(v))
                for c, v in self.fills.items()}
        cols.update({c: F.coalesce(F.col(c), F.lit(v)) for c, v in self.constants.items()})
        return df.withColumns(cols).drop(*self.dropped)


# ------------------------------------------------------------------------ T4
class Standardize(Estimator):
    """(x - mean) / population-sd, sd 0 -> 1 (T4).  ``ml.StandardScaler``
    divides by the sample sd and does not centre by default, so it is not
    used.  ``suffix`` writes new columns instead of overwriting."""

    def __init__(self, cols, with_mean: bool = True, with_std: bool = True, suffix: str = ""):
        super().__init__()
        self.cols, self.with_mean, self.with_std, self.suffix = list(cols), with_mean, with_std, suffix

    def _fit(self, df: DataFrame) -> "StandardizeModel":
        aggs = []
        for c in self.cols:
            aggs += [F.avg(F.col(c)).alias(f"m_{c}"), F.stddev_pop(F.col(c)).alias(f"s_{c}")]
        row = df.agg(*aggs).first() if aggs else {}
        mean = {c: float(row[f"m_{c}"] or 0.0) for c in self.cols}
        sd = {c: (float(row[f"s_{c}"]) if row[f"s_{c}"] else 1.0) for c in self.cols}
        return StandardizeModel(mean, sd, self.with_mean, self.with_std, self.suffix)


class StandardizeModel(Model):
    def __init__(self, mean, sd, with_mean=True, with_std=True, suffix=""):
        super().__init__()
        self.mean, self.sd, self.with_mean, self.with_std, self.suffix = mean, sd, with_mean, with_std, suffix

    def _transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c in self.mean:
            e = F.col(c).cast("double")
            if self.with_mean:
                e = e - F.lit(self.mean[c])
            if self.with_std:
                e = e / F.lit(self.sd[c])
            out[c + self.suffix] = e
        return df.withColumns(out)


# ------------------------------------------------------------------- T5, T6
def _levels(df: DataFrame, cols, max_levels: int) -> dict:
    """Sorted distinct non-null values per column in one job.  The (column,
    value) pairs are map-side de-duplicated before the shuffle."""
    if not cols:
        return {}
    long = (df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in cols])).alias("kv"))
        .select("kv.k", "kv.v").where(F.col("v").isNotNull()).distinct())
    got = long.limit(max_levels + 1).collect()  # at most max_levels + 1 rows
    if len(got) > max_levels:
        raise ValueError(f"more than {max_levels} category levels; "
                         "use OrdinalCodes(table mode) instead of one-hot")
    out = {c: [] for c in cols}
    for r in got:
        out[r["k"]].append(r["v"])
    return {c: sorted(v) for c, v in out.items()}


class OneHot(Estimator):
    """One-hot over sorted training categories; an unseen or null value gives
    all zeros (T5, ``handle_unknown='ignore'``).  Output columns
    ``<col>_<value>`` (doubles); the source columns are dropped."""

    def __init__(self, cols, max_levels: int = 10_000, keep_source: bool = False):
        super().__init__()
        self.cols, self.max_levels, self.keep_source = list(cols), max_levels, keep_source

    def _fit(self, df: DataFrame) -> "OneHotModel":
        return OneHotModel(_levels(df, self.cols, self.max_levels), self.keep_source,
                           set(df.columns) - set(self.cols))


class OneHotModel(Model):
    def __init__(self, levels: dict, keep_source: bool = False, taken=()):
        super().__init__()
        self.levels, self.keep_source = levels, keep_source
        self.names = {}
        seen = set(taken)  # over all columns: ``a`` = "b_c" and ``a_b`` = "c" mustn't share a name
        for c, vals in levels.items():
            for v in vals:
                name = f"{c}_{_sanitize(v)}"
                while name in seen:
                    name += "_"
                seen.add(name)
                self.names[(c, v)] = name

    def output_columns(self) -> list[str]:
        return [self.names[(c, v)] for c, vals in self.levels.items() for v in vals]

    def _transform(self, df: DataFrame) -> DataFrame:
        out = {self.names[(c, v)]: F.when(F.col(c).cast("string") == F.lit(v), 1.0).otherwise(0.0)
               for c, vals in self.levels.items() for v in vals}
        df = df.withColumns(out)
        return df if self.keep_source else df.drop(*self.levels)


class OrdinalCodes(Estimator):
    """Lexicographic integer codes of the training categories, unknown/null ->
    -1 (T6).  Up to ``literal_levels`` levels the codes are a literal map in
    the projection; above that they are a distributed (value, code) table
    ranked without a single-partition window and joined back."""

    def __init__(self, cols, unknown: int = -1, suffix: str = "", literal_levels: int = 50_000):
        super().__init__()
        self.cols, self.unknown, self.suffix, self.literal_levels = list(cols), unknown, suffix, literal_levels

    def _fit(self, df: DataFrame) -> "OrdinalCodesModel":
        try:
            lv = _levels(df, self.cols, self.literal_levels)
            return OrdinalCodesModel({c: {v: i for i, v in enumerate(vs)} for c, vs in lv.items()},
                                     None, self.unknown, self.suffix)
        except ValueError:
            tables = {}
            for c in self.cols:
                d = df.select(F.col(c).cast("string").alias("__value")).where("__value IS NOT NULL").distinct()
                tables[c] = global_index(d, ["__value"], name="__code")
            return OrdinalCodesModel(None, tables, self.unknown, self.suffix)


class OrdinalCodesModel(Model):
    def __init__(self, codes, tables, unknown=-1, suffix=""):
        super().__init__()
        self.codes, self.tables, self.unknown, self.suffix = codes, tables, unknown, suffix

    def _transform(self, df: DataFrame) -> DataFrame:
        if self.codes is not None:
            out = {}
            for c, m in self.codes.items():
                lookup = F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.lit(v))]) if m else None
                e = F.try_element_at(lookup, F.col(c).cast("string")) if m else F.lit(None)
                out[c + self.suffix] = F.coalesce(e, F.lit(self.unknown)).cast("int")
            return df.withColumns(out)
        for c, t in self.tables.items():
            df = (df.join(t.withColumnRenamed("__value", "__k_" + c),
                          F.col(c).cast("string") == F.col("__k_" + c), "left")
                  .withColumn(c + self.suffix, F.coalesce(F.col("__code").cast("int"), F.lit(self.unknown)))
                  .drop("__k_" + c, "__code"))
        return df


# ------------------------------------------------------------------------ T8
class Polynomial(Model):
    """All monomials of degree 1..d without bias (T8), as column products.
    Names: ``a``, ``a_pow2``, ``a_x_b``; order as scikit-learn's
    (combinations with replacement).  ``max_width`` guards the C(p+d,d)-1
    blow-up."""

    def __init__(self, cols, degree: int = 2, max_width: int = 5000, drop_source: bool = False):
        super().__init__()
        self.cols, self.degree, self.max_width, self.drop_source = list(cols), degree, max_width, drop_source

    def terms(self):
        out = []
        for d in range(1, self.degree + 1):
            out.extend(combinations_with_replacement(self.cols, d))
        if len(out) > self.max_width:
            raise ValueError(f"degree {self.degree} on {len(self.cols)} columns gives "
                             f"{len(out)} terms > max_width={self.max_width}")
        return out

    @staticmethod
    def term_name(term) -> str:
        parts, i = [], 0
        while i < len(term):
            j = i
            while j < len(term) and term[j] == term[i]:
                j += 1
            parts.append(term[i] if j - i == 1 else f"{term[i]}_pow{j - i}")
            i = j
        return "_x_".join(parts)

    def output_columns(self):
        return [self.term_name(t) for t in self.terms()]

    def _transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for t in self.terms():
            if len(t) == 1:
                continue
            e = F.col(t[0]).cast("double")
            for c in t[1:]:
                e = e * F.col(c).cast("double")
            out[self.term_name(t)] = e
        df = df.withColumns(out)
        return df


# ------------------------------------------------------------------------ T9
class Pca(Estimator):
    """PCA by component count (int) or by explained-variance share (float <
    1: smallest k whose cumulative share reaches it) (T9).  Input is a vector
    column or an array column; data are centred first (MLlib projects
    uncentred data).  The covariance is a distributed Gramian; only the p x p
    eigen-problem runs on the driver."""

    def __init__(self, input_col: str, n_components, output_col: str = "pca", k_max: int | None = None):
        super().__init__()
        self.input_col, self.n_components, self.output_col, self.k_max = input_col, n_components, output_col, k_max

    def _fit(self, df: DataFrame) -> "PcaModel":
        from pyspark.ml.feature import StandardScaler
        vec = _as_vector(df, self.input_col)
        scaler = StandardScaler(inputCol="__vec", outputCol="__cvec", withMean=True, withStd=False).fit(vec)
        centred = scaler.transform(vec)
        p = len(centred.select("__cvec").first()[0])
        k_fit = p if isinstance(self.n_components, float) else min(int(self.n_components), p)
        if self.k_max:
            k_fit = min(k_fit, self.k_max)
        pca = _MLPCA(k=k_fit, inputCol="__cvec", outputCol="__pvec").fit(centred)
        ratios = list(pca.explainedVariance.toArray())
        if isinstance(self.n_components, float):
            acc, k = 0.0, len(ratios)
            for i, r in enumerate(ratios):
                acc += r
                if acc >= self.n_components - 1e-12:
                    k = i + 1
                    break
        else:
            k = k_fit
        return PcaModel(self.input_col, self.output_col, scaler, pca, k, ratios)


def _as_vector(df: DataFrame, col: str) -> DataFrame:
    from pyspark.ml.linalg import VectorUDT
    if isinstance(df.schema[col].dataType, VectorUDT):
        return df.withColumn("__vec", F.col(col))
    return df.withColumn("__vec", array_to_vector(F.col(col).cast("array<double>")))


class PcaModel(Model):
    def __init__(self, input_col, output_col, scaler, pca, k, ratios):
        super().__init__()
        self.input_col, self.output_col, self.scaler, self.pca, self.k, self.ratios = (
            input_col, output_col, scaler, pca, k, ratios)

    def explained(self, spark) -> DataFrame:
        acc, rows = 0.0, []
        for i, r in enumerate(self.ratios):
            acc += r
            rows.append((i, float(r), float(acc)))
        return spark.createDataFrame(rows, "component int, share double, cumulative double")

    def _transform(self, df: DataFrame) -> DataFrame:
        out = self.pca.transform(self.scaler.transform(_as_vector(df, self.input_col)))
        arr = vector_to_array(F.col("__pvec"))
        return (out.withColumn(self.output_col, F.slice(arr, 1, self.k))
                .drop("__vec", "__cvec", "__pvec"))


# ---------------------------------------------------------------------- T7/T10
def build_pipeline(numeric, categorical=(), zero=(), scale: bool = True,
                   encoder: str = "onehot", poly_degree: int | None = None) -> Pipeline:
    """The column router of the reference (T7) as an ``ml.Pipeline``:
    numeric -> median impute (zero-impute list separately) -> standardise;
    categorical -> 'None' fill -> one-hot (or ordinal codes)."""
    numeric = [c for c in numeric if c not in set(zero)]
    stages = [Impute(median=numeric, zero=zero, constant={c: "None" for c in categorical})]
    if scale:
        stages.append(_DeferredStandardize(list(zero) + numeric))
    if poly_degree and poly_degree > 1:  # of the scaled columns; its terms aren't scaled again
        stages.append(_DeferredPolynomial(list(zero) + numeric, poly_degree))
    if categorical:
        stages.append(OneHot(categorical) if encoder == "onehot" else OrdinalCodes(categorical))
    return Pipeline(stages=stages)


class _DeferredStandardize(Estimator):
    """Standardise the numeric columns that survive imputation (all-null
    training columns are gone)."""

    def __init__(self, cols):
        super().__init__()
        self.cols = list(cols)

    def _fit(self, df: DataFrame):
        return Standardize([c for c in self.cols if c in df.columns])._fit(df)


class _DeferredPolynomial(Estimator):
    """Expand the numeric columns that survive imputation."""

    def __init__(self, cols, degree: int):
        super().__init__()
        self.cols, self.degree = list(cols), degree

    def _fit(self, df: DataFrame):
        return Polynomial([c for c in self.cols if c in df.columns], self.degree)


def feature_names(model, numeric_prefix: str = "num__", cat_prefix: str = "cat__") -> list[str]:
    """Ordered output feature names of a fitted ``build_pipeline``."""
    names = []
    for st in model.stages:
        if isinstance(st, StandardizeModel):
            names += [numeric_prefix + c for c in st.mean]
        elif isinstance(st, OneHotModel):
            names += [cat_prefix + c for c in st.output_columns()]
        elif isinstance(st, OrdinalCodesModel):
            names += [cat_prefix + c for c in (st.codes if st.codes is not None else st.tables)]
        elif isinstance(st, Polynomial):
            names += [numeric_prefix + c for c in st.output_columns() if c not in st.cols]
    return names


def feature_columns(model) -> list[str]:
    """Column names (in the transformed DataFrame) that feed the regressor."""
    cols = []
    for st in model.stages:
        if isinstance(st, StandardizeModel):
            cols += [c + st.suffix for c in st.mean]
        elif isinstance(st, OneHotModel):
            cols += st.output_columns()
        elif isinstance(st, OrdinalCodesModel):
            cols += [c + st.suffix for c in (st.codes if st.codes is not None else st.tables)]
        elif isinstance(st, Polynomial):
            cols += [c for c in st.output_columns() if c not in st.cols]
    return cols


def compact(model, df: DataFrame) -> tuple[DataFrame, dict, dict]:
    """``df`` through a fitted ``build_pipeline`` but for the columns that
    ``linear.gram`` makes itself: (rows, its ``indicators``, its ``products``)."""
    indicators, products = {}, {}
    for st in model.stages:
        if isinstance(st, OneHotModel):
            indicators.update({c: {v: st.names[c, v] for v in vals} for c, vals in st.levels.items()})
        elif isinstance(st, Polynomial):
            products.update({st.term_name(t): t for t in st.terms() if len(t) > 1})
        else:
            df = st.transform(df)
    return df, indicators, products


def assemble(df: DataFrame, cols, out: str = "features") -> DataFrame:
    """Vector column for MLlib estimators."""
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


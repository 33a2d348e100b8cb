"""Composed analyses (the reference's three segmentations and the Pareto
report), each a chain of DataFrame operators; what several of them read is stored
once in the checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import to_number, to_ts
from ..functions.text import MIXED_TOKEN, stop_words
from ..operators import clean as C
from ..operators import cluster as CL
from ..operators import features as FE
from ..operators import pareto as P
from ..operators import project as PJ
from ..operators import text as T
from ..operators import view as V
from ..operators.quality import as_array
from ..session import cut_lineage


def text_segmentation(df: DataFrame, key: str, text_cols: list[str], k_min: int = 2, k_max: int = 10,
                      seed: int = 42, max_features: int = 10000) -> dict[str, DataFrame]:
    """Text path: combine and drop blank texts (C4, C3), TF-IDF (E9), sweep k
    by silhouette (F3, F4), k-means with the chosen k (F1, model reused),
    projection (P1), statistics and keywords (H12, H13)."""
    C.validate(df, text_cols, k_range=(k_min, k_max))
    d = cut_lineage(V.drop_blank(V.combine_text(df, text_cols), "text_combined"))
    vec = cut_lineage(T.tfidf_vectors(d, key, "text_combined", max_features))
    if vec.count() < 2:
        raise C.ValidationError("fewer than 2 documents to cluster")
    sweep, models = CL.sweep_models(vec, "features", range(k_min, k_max + 1), seed=seed)
    best_k = CL.best_k_silhouette(sweep, k_min).first()["best_k"]
    if best_k not in models:  # no score beat -1 and the least k was under 2
        models = CL.sweep_models(vec, "features", [best_k], seed=seed)[1]
    # the axes are found on the stored vectors: on labelled rows every pass would label them anew
    proj = PJ.project(vec, "features", 2, prefix="tsne_", method="random_pca")
    labelled = CL.assign(proj, "features", models[best_k], out="cluster_text")
    result = d.join(labelled.select(key, "cluster_text", "tsne_1", "tsne_2"), key)
    return {"result": result, "sweep": sweep,
            "stats": T.text_cluster_stats(result, "cluster_text"),
            "keywords": T.cluster_keywords(result, key, "cluster_text", "text_combined")}


def numeric_segmentation(df: DataFrame, key: str, features: list[str], method: str = "density",
                         k: int | None = None, k_max: int = 10, seed: int = 42, cell: float = 0.5,
                         min_samples: int = 5, min_cluster_size: int = 5) -> dict[str, DataFrame]:
    """Numeric path: median impute (B5), standardise (E1), segment, project
    in 2-D and 3-D (P1), statistics (H1), summary (F9) and quality (G2).

    ``method='density'`` (default, as the reference) uses the grid density
    clustering (F6, noise = -1); ``'kmeans'`` uses k-means
    with k chosen by silhouette unless given."""
    from pyspark.ml.feature import VectorAssembler
    from ..operators import profile as H
    from ..operators.density import density_cluster
    from ..operators.quality import silhouette
    C.validate(df, features, min_features=2)
    d = FE.standardize(C.impute_median(df.select(key, *features), features), features, suffix="_z")
    zc = [f + "_z" for f in features]
    v = cut_lineage(VectorAssembler(inputCols=zc, outputCol="features").transform(d))
    if method == "density":
        lab = density_cluster(v, zc, cell, min_samples, min_cluster_size, out="cluster_num")
    else:
        sweep, models = CL.sweep_models(v, "features", range(2, k_max + 1) if k is None else [k], seed=seed)
        k = k or CL.best_k_silhouette(sweep).first()["best_k"]
        lab = CL.assign(v, "features", models[k], out="cluster_num")
    lab = cut_lineage(PJ.project(PJ.project(lab, "features", 2, "p2_"), "features", 3, "p3_"))
    return {"result": lab.drop("features"),
            "stats": H.cluster_stats(lab, "cluster_num", features),
            "summary": CL.cluster_summary(lab, "cluster_num"),
            "quality": silhouette(lab, "features", "cluster_num")}


_CUSTOM: dict = {}


def register_type(name: str, fn) -> None:
    """``fn(df, column) -> (df, [feature columns])`` builds the features of
    every column of the semantic type ``name`` (a built-in type is replaced)."""
    _CUSTOM[name] = fn


def unregister_type(name: str) -> None:
    _CUSTOM.pop(name, None)


def mixed_features(df: DataFrame, key: str, types: dict[str, str], text_max_features: int = 100) -> DataFrame:
    """Per-type transforms concatenated in column order: numeric -> median
    impute + standardise; categorical -> 'missing' + one-hot; text -> TF-IDF
    (100 terms, 1-character tokens, French + extra stop words), dense;
    date -> year, month, day, weekday; vector -> a precomputed ``array<float>``
    (sentence vectors, E11) as it is, none of them missing."""
    from pyspark.ml.feature import VectorAssembler
    cols = list(types)
    C.validate(df, cols, {c: t for c, t in types.items() if t not in _CUSTOM} | {c: C.NUMERIC for c, t in types.items() if t in _CUSTOM})
    # bad numbers and dates in text columns are missing
    as_type = {C.NUMERIC: to_number, C.DATE: to_ts}
    d = df.select(key, *[as_type[types[c]](c).alias(c) if types[c] in as_type and types[c] not in _CUSTOM and df.schema[c].dataType.typeName() == "string"
                         else F.col(c) for c in cols])
    parts = []
    built_in = [c for c in cols if types[c] not in _CUSTOM]
    nums = [c for c in built_in if types[c] == C.NUMERIC]
    if nums:
        d = FE.standardize(C.impute_median(d, nums), nums, suffix="_z")
    cats = [c for c in built_in if types[c] == C.CATEGORICAL]
    if cats:
        d = C.impute_const(d.select(*[F.col(c).cast("string").alias(c) if c in cats else F.col(c) for c in d.columns]),
                           cats, "missing")
        d = FE.one_hot_vectors(d, cats, out_col="_onehot")
    for c in cols:
        t = types[c]
        if t in _CUSTOM:
            d, made = _CUSTOM[t](d, c)
            parts += made
        elif t == C.NUMERIC:
            parts.append(c + "_z")
        elif t == C.CATEGORICAL:
            if "_onehot" not in parts:
                parts.append("_onehot")
        elif t == C.DATE:
            d = FE.date_parts(d, c, prefix=f"_{c}")
            parts += [f"_{c}_year", f"_{c}_month", f"_{c}_day", f"_{c}_weekday"]
        elif t == C.VECTOR:
            d = FE.embedding_vectors(d, c, f"_{c}_vec")
            parts.append(f"_{c}_vec")
        elif t == C.TEXT:
            tv = T.tfidf_vectors(d.select(key, F.coalesce(F.col(c).cast("string"), F.lit("")).alias("_t")), key, "_t",
                                 text_max_features, stop_words("french_mixed"), MIXED_TOKEN, out=f"_{c}_tfidf")
            d = d.join(tv, key, "left")
            parts.append(f"_{c}_tfidf")
    return VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="keep").transform(d) \
        .select(key, "features")


def mixed_cluster(df: DataFrame, key: str, types: dict[str, str], k_max: int = 100, seed: int = 42,
                  n_init: int = 10, encoder: str = "pca", epochs: int = 50) -> dict[str, DataFrame]:
    """mixed features (E10) -> linear encoder to max(2, min(32, d // 2))
    dimensions (F7b, PCA) -> k by vote (F5) over 2..min(k_max, n-1) -> k-means
    (F1, model reused) -> 2-D projection -> label. Too few rows: F8.
    ``encoder='autoencoder'`` trains the non-linear encoder (F7a) instead."""
    from pyspark.ml.feature import PCA
    feats = cut_lineage(mixed_features(df, key, types))
    n = feats.count()
    width = len(feats.select("features").first()[0])
    dim = max(2, min(32, width // 2))
    if encoder == "autoencoder":  # F7a
        from ..operators.encoder import encode, fit_autoencoder
        model = fit_autoencoder(feats, "features", dim=32, epochs=epochs, batch=256, seed=seed)
        enc = cut_lineage(encode(feats, "features", model).select(key, "encoded"))
    else:  # F7b
        enc = cut_lineage(PCA(k=min(dim, width), inputCol="features", outputCol="encoded").fit(feats).transform(feats).select(key, "encoded"))
    top = min(k_max, n - 1)
    if top < 2:
        return {"result": CL.label_unclassified(df), "sweep": None}
    sweep, models = CL.sweep_models(enc, "encoded", range(2, top + 1), seed=seed, n_init=n_init, metrics="all")
    best_k = CL.best_k_vote(sweep, n).first()["best_k"]
    lab = CL.assign(PJ.project(enc, "encoded", 2, prefix="p2_"), "encoded", models[best_k], out="cluster_mixed")
    result = df.join(lab.select(key, F.col("cluster_mixed").cast("string").alias("cluster_mixed"), "p2_1", "p2_2"), key)
    return {"result": result, "sweep": sweep, "best_k": best_k}


def pareto_report(df: DataFrame, value: str, key, cluster: str, threshold: float = 80.0, clusters=None,
                  label_col: str | None = None) -> dict[str, DataFrame]:
    """I16: every Pareto table from one stored ranked table."""
    p = cut_lineage(P.pareto(df, value, key, cluster_col=cluster, clusters=clusters))
    g = P.gini(p, value)
    o = P.outlier_summary(p, value)
    pot = P.improvement_potential(p, value)
    st = P.cluster_stability(p, cluster, value)
    summ = P.pareto_summary(p, value, threshold)
    recs = P.recommendations(g, o, pot, st, threshold)
    cmp_ = P.compare_clusters(p, cluster, value)
    return {"pareto": p, "key_items": P.key_items(p, threshold), "summary": summ, "gini": g,
            "outliers": o, "outlier_rows": P.iqr_outliers(p, value), "stability": st,
            "stability_by_cluster": P.cluster_profile(p, cluster, value), "potential": pot,
            "comparison": cmp_, "recommendations": recs, "rule": P.pareto_rule(p),
            "verdict": P.concentration_verdict(summ), "advice": P.quick_advice(summ),
            "action_plan": P.action_plan(recs), "monitor": P.monitor_kpis(g, summ, st, o, threshold),
            "chart": P.pareto_chart_data(p, value, label_col, 100, threshold),
            "potential_chart": P.potential_chart_data(pot),
            "comparison_chart": P.comparison_chart_data(cmp_, cluster)}


__all__ = ["text_segmentation", "numeric_segmentation", "mixed_features", "mixed_cluster", "pareto_report",
           "as_array"]

"""One dataset under study: its spectra, regions, groups and features, and every analysis by name.

>>> s = Session(peaks, pixels)
>>> s.add_region("lesion", s.threshold(885.55, 70))
>>> s.set_features([303.23, 885.55])
>>> s.compare(a, b).orderBy("q_value")

All of it is lazy: verbs return DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import annotation, intake, multivariate, neighbours, regions, spatial, spectra, statistics


class Session:
    def __init__(self, peaks: DataFrame, pixels: DataFrame, ppm: float = 50.0, norm: str = "tic", reduce: str = "sum"):
        self.peaks, self.pixels, self.ppm, self.norm, self.reduce = peaks, pixels, ppm, norm, reduce
        self.regions: dict[str, DataFrame] = {}
        self.groups: dict[str, list[str]] = {}
        self.features: list[float] = []

    # What is there

    def set_features(self, mzs: list[float]) -> None:
        self.features = sorted(float(m) for m in mzs)

    def add_region(self, name: str, mask: DataFrame, group: str | None = None) -> None:
        self.regions[name] = mask.select("pixel_id")
        if group:
            self.groups.setdefault(group, []).append(name)

    def region(self, name: str) -> DataFrame:
        return self.regions[name]

    def group(self, name: str) -> DataFrame:
        masks = [self.regions[r] for r in self.groups[name]]
        out = masks[0]
        for m in masks[1:]:
            out = out.union(m)
        return out.distinct()

    def labels(self, masks: dict[int, DataFrame]) -> DataFrame:
        """pixel_id, label; a pixel of several masks has the least."""
        parts = [m.select("pixel_id", F.lit(k).alias("label")) for k, m in masks.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out.groupBy("pixel_id").agg(F.min("label").alias("label"))

    def region_names(self) -> list[str]:
        return list(self.regions)

    def group_names(self) -> list[str]:
        return list(self.groups)

    def save(self, path: str) -> None:
        """Features, groups and regions as tables under path, with the dataset's fingerprint; spectra stay where they are."""
        spark = self.peaks.sparkSession
        out = spark.createDataFrame([], "region string, pixel_id long")
        for name, mask in self.regions.items():
            out = out.union(mask.select(F.lit(name), F.col("pixel_id").cast("long")))
        out.write.mode("overwrite").partitionBy("region").parquet(f"{path}/regions")
        settings = [(name, list(self.groups), [g for g, r in self.groups.items() if name in r]) for name in self.regions]
        spark.createDataFrame(settings, "region string, groups array<string>, own array<string>").write.mode("overwrite").parquet(f"{path}/groups")
        spark.createDataFrame([(m,) for m in self.features], "mz double").write.mode("overwrite").parquet(f"{path}/features")
        spectra.fingerprint(self.pixels, self.peaks).write.mode("overwrite").parquet(f"{path}/fingerprint")

    def load(self, path: str) -> None:
        """Take up what save wrote; a ValueError if that was for other pixels."""
        spark = self.peaks.sparkSession
        own = spectra.fingerprint(self.pixels, self.peaks).select("n_pixels", "digest").first()
        if spark.read.parquet(f"{path}/fingerprint").select("n_pixels", "digest").first() != own:
            raise ValueError(f"the session in {path} is of another dataset")
        saved = spark.read.schema("pixel_id long, region string").parquet(f"{path}/regions")
        rows = spark.read.parquet(f"{path}/groups").orderBy("region").collect()  # a row a region
        self.regions = {r["region"]: saved.where(F.col("region") == r["region"]).select("pixel_id") for r in rows}
        self.groups = {g: [r["region"] for r in rows if g in r["own"]] for g in (rows[0]["groups"] if rows else [])}
        self.set_features([r["mz"] for r in spark.read.parquet(f"{path}/features").collect()])

    # Images and matrices

    def matrix(self, mzs: list[float] | None = None) -> DataFrame:
        """pixel_id, feature (the place in the feature list), v for every pixel and feature, normalised."""
        mzs = self.features if mzs is None else sorted(mzs)
        targets = self.peaks.sparkSession.createDataFrame([(k, m) for k, m in enumerate(mzs)], "feature_id int, target_mz double")
        dense = spectra.dense_grid(spectra.extract_sparse(self.peaks, targets, self.ppm, self.reduce), self.pixels, list(range(len(mzs))))
        if self.norm != "none":
            dense = spectra.normalised(dense, spectra.norm_factors(spectra.pixel_stats(self.peaks), self.norm))
        return dense.select("pixel_id", F.col("feature_id").alias("feature"), F.col("value").alias("v"))

    def ion_image(self, mz: float) -> DataFrame:
        return spectra.image(self.pixels, self.matrix([mz]).select("pixel_id", F.col("v").alias("value")))

    def composite(self, mzs: list[float], weight: str = "raw") -> DataFrame:
        return spectra.composite(self.matrix(mzs).select("pixel_id", F.col("feature").alias("feature_id"), F.col("v").alias("value")), weight)

    def threshold(self, mz: float, cut: float, percentile: bool = True) -> DataFrame:
        return spatial.threshold_mask(self.matrix([mz]), cut, percentile)

    def ring(self, mask: DataFrame, width: float, mode: str = "inner") -> DataFrame:
        return spatial.ring(self.pixels, mask, width, mode)

    def invert(self, mask: DataFrame) -> DataFrame:
        return spatial.invert(self.pixels, mask)

    # Analyses

    def _two(self, a: DataFrame, b: DataFrame) -> DataFrame:
        grp = a.select("pixel_id", F.lit("A").alias("grp")).union(b.select("pixel_id", F.lit("B").alias("grp")))
        return self.matrix().join(grp, "pixel_id")

    def compare(self, a: DataFrame, b: DataFrame, method: str = "mwu") -> DataFrame:
        return statistics.two_group_test(self._two(a, b), method)

    def labelled(self, masks: dict[int, DataFrame]) -> DataFrame:
        return self.matrix().join(self.labels(masks), "pixel_id")

    def discriminating(self, masks: dict[int, DataFrame], top_n: int = 15) -> DataFrame:
        return regions.markers(self.labelled(masks), top_n)

    def multigroup(self, masks: dict[int, DataFrame], method: str = "kruskal") -> DataFrame:
        values = self.labelled(masks).withColumnRenamed("label", "grp")
        if method == "kruskal":
            return statistics.bh(statistics.kruskal(values).withColumn("p_value", statistics.p_of_chi2("h", "df")), "p_value", "q_value", [])
        return statistics.bh(statistics.anova(values).withColumn("p_value", statistics.p_of_f("f", "df_between", "df_within")), "p_value", "q_value", [])

    def markers(self, masks: dict[int, DataFrame], shrink: float = 2.0) -> DataFrame:
        return regions.shrunken_centroids(self.labelled(masks), shrink)

    def localisation(self, mask: DataFrame) -> DataFrame:
        return regions.localisation(self.labelled({1: mask, 2: self.pixels}), 1)

    def membership(self, masks: dict[int, DataFrame], min_prevalence: float = 0.5) -> DataFrame:
        return regions.membership(self.labelled(masks), min_prevalence)

    def colocalize(self, feature: int) -> DataFrame:
        return regions.colocalisation(self.matrix(), feature)

    def modules(self, k: int = 4) -> list[tuple[int, int]]:
        return multivariate.modules(regions.coloc_matrix(self.matrix()), list(range(len(self.features))), k)

    def segment(self, k: int = 0) -> DataFrame:
        dense = self.matrix()
        n = max(1, min(5, len(self.features)))
        return multivariate.segment(dense, k or multivariate.choose_k(dense, n_components=n), n)

    def pca(self, k: int = 5):
        return multivariate.pca(self.matrix(), k)

    def nmf(self, k: int = 5):
        return multivariate.nmf(self.matrix(), k)

    def plsda(self, masks: dict[int, DataFrame], k: int = 2):
        return multivariate.pls(self.labelled(masks), k)

    def find_spatial(self, **params) -> DataFrame:
        return spatial.find_spatial(self.matrix(), self.pixels, **params)

    def find_peaks(self, bin_ppm: float = 15.0, **params) -> DataFrame:
        low = self.peaks.agg(F.min("mz")).first()[0]
        cube = spectra.cube(self.peaks, low, bin_ppm).withColumnRenamed("value", "v")
        mean = spectra.mean_spectrum(cube, self.pixels).withColumnRenamed("mean", "v")
        return intake.pick_peaks(mean, **params)

    def annotate(self, lipids: DataFrame, mode: str = "negative", ppm: float = 10.0) -> DataFrame:
        feats = self.peaks.sparkSession.createDataFrame([(k, m) for k, m in enumerate(self.features)], "feature_id int, mz double")
        return annotation.annotate(feats, annotation.ion_index(lipids, mode), ppm)

    def run(self, step: str, **params):
        """Any analysis of STEPS by its id."""
        return STEPS[step][0](self, **params)


#: Analyses by id: what runs them, and what they need.
STEPS = {
    "find_spatial_features": (Session.find_spatial, ()), "find_coherent_features": (lambda s, **p: spatial.quality(spatial.moran(m := s.matrix(), s.pixels).join(spatial.hotspot(m), "feature").join(spatial.chaos(m, s.pixels), "feature")), ()),
    "find_peaks": (Session.find_peaks, ()), "auto_segment": (Session.segment, ("features",)), "roi_comparison": (Session.compare, ("a", "b", "features")),
    "region_comparison": (lambda s, a, b: statistics.moments(s._two(a, b)).select("feature", (F.col("mean_b") - F.col("mean_a")).alias("diff")), ("a", "b")),
    "class_comparison": (lambda s, masks, classes: statistics.two_group(regions.class_values(s.labelled(masks), classes).withColumn("grp", F.when(F.col("label") == min(masks), "A").otherwise("B"))), ("masks", "classes")),
    "class_composition": (lambda s, masks, classes: regions.class_composition(s.labelled(masks), classes), ("masks", "classes")),
    "marker_panel": (lambda s, pairs, **p: regions.marker_panel([s.compare(a, b) for a, b in pairs], **p), ("pairs", "features")),
    "discriminating_features": (Session.discriminating, ("masks", "features")), "multigroup_features": (Session.multigroup, ("masks", "features")), "roi_localization": (Session.localisation, ("mask", "features")),
    "filter_auc": (lambda s, table, **p: regions.filter_auc(table, **p), ("table",)), "shrunken_centroids": (Session.markers, ("masks", "features")),
    "dgmm": (lambda s, mz, k=3: multivariate.two_level_mixture(s.matrix([mz]), s.pixels, k), ("mz",)), "region_membership": (Session.membership, ("masks", "features")), "colocalize": (Session.colocalize, ("feature", "features")),
    "coloc_modules": (Session.modules, ("features",)), "region_correlation": (lambda s, masks: regions.region_correlation(s.labelled(masks)), ("masks", "features")),
    "pca": (Session.pca, ("features",)), "nmf": (Session.nmf, ("features",)), "plsda": (Session.plsda, ("masks", "features")),
    "classify_cv": (lambda s, masks, folds=5: multivariate.confusion(s.labelled(masks), folds), ("masks", "features")), "classify_map": (lambda s, masks: multivariate.classify(d := s.labelled(masks), multivariate.pls(d)), ("masks", "features")),
    "embedding": (lambda s, method="neighbours", **k: neighbours.embedding(s.matrix(), **k) if method == "neighbours" else multivariate.pca(s.matrix(), 2)[0], ("features",)), "annotate": (Session.annotate, ("lipids", "features")),
}


def unmet(step: str, given: dict, session: Session) -> list[str]:
    """What a step still needs."""
    return [n for n in STEPS[step][1] if not (session.features if n == "features" else n in given)]

"""One query per operator; each runs over whole tables."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LOOKUP_TABLES, Config
from ..functions.tokens import luminosity, token_ngrams
from ..operators import cluster, explore, lookups, measures, search, selections, votes
from ..operators.perturb import block_median_fuzz
from ..operators.ranking import band_percentile_rows
from ..operators.regions import region_tokens
from ..plans.jobs import candidate_measures, run_actions
from ..plans.measure import measure_images
from ..plans.search import Matches, find_similar
from ..sources import images as image_files
from ..sources.store import RunStore, asset_key, cut_lineage, fresh_dir, image_name
from . import inputs
from .inputs import tidy, values_at, vector_text

QUERIES: dict = {}

QUANTILES = (5, 15, 25, 50, 75, 85, 95)
NATIVE_QUANTILES = (5, 25, 50, 75, 95)
# how finely the values of each band are bucketed while ranking
BUCKET_WIDTHS = {"r": 1.0, "g": 0.5, "b": 0.01}
TOKEN_CAPS = {"phash": 40, "ward": 30}
SETTINGS = Config(
    n_clusters_group=inputs.CLUSTERS,
    max_iter_group=inputs.ROUNDS,
    phash_bits=inputs.PHASH_BITS,
    phash_chunk_len=inputs.NGRAM,
)
# small pictures need small settings
SMALL = replace(
    SETTINGS, x_down=8, ward_x_down=4, n_clusters=3, max_iterations=3, max_patches=1,
    ward_clusters=5,
)


def query(name: str):
    """Register a query. Votes, decimal(38,0) in the operators, come as bigint."""

    def keep(function):
        def run(spark, sf_dir):
            df = function(spark, sf_dir)
            votes = [c for c, kind in df.dtypes if kind == "decimal(38,0)"]
            return df.withColumns({c: F.col(c).cast("bigint") for c in votes}) if votes else df

        run.__doc__ = function.__doc__
        QUERIES[name] = run
        return function

    return keep


# --- sources -----------------------------------------------------------------


def _png_folder(spark: SparkSession, images: DataFrame) -> str:
    folder = fresh_dir(spark, "images")
    named = images.withColumn("name", F.concat(F.col("image_id").cast("string"), F.lit(".png")))
    image_files.write_png(named, folder)
    return folder


@query("image_scan")
def image_scan(spark, sf_dir):
    folder = _png_folder(spark, inputs.byte_images(spark, sf_dir))
    files = image_files.image_scan(spark, folder, "*.png")
    return files.select(
        image_name(F.col("path")).alias("name"),
        image_files.image_format(F.col("content")).alias("format"),
        (F.length("content") == F.col("length")).alias("is_whole"),
    )


@query("image_meta")
def image_meta(spark, sf_dir):
    folder = _png_folder(spark, inputs.byte_images(spark, sf_dir))
    return image_files.image_meta(spark, folder, "*.png").select(
        image_name(F.col("image_id")).alias("name"),
        "format",
        "width",
        "height",
        "n_channels",
        "is_valid",
    )


@query("pixel_rows")
def pixel_rows(spark, sf_dir):
    folder = _png_folder(spark, inputs.byte_images(spark, sf_dir))
    decoded = image_files.image_bands(image_files.image_load(spark, folder, "*.png"))
    return image_files.pixel_rows(decoded, "image_id").withColumn(
        "image_id", image_name(F.col("image_id"))
    )


def _store(spark: SparkSession, config: Config = SETTINGS) -> RunStore:
    return RunStore(spark, replace(config, root=fresh_dir(spark, "run")))


@query("measures_io")
def measures_io(spark, sf_dir):
    store = _store(spark)
    kept = store.save(inputs.known_items(spark, sf_dir), store.measures_path())
    return kept.select(
        "image_id",
        vector_text(F.col("features")).alias("features"),
        F.array_join("phash", ",").alias("phash"),
    )


@query("lookup_io")
def lookup_io(spark, sf_dir):
    store = _store(spark)
    assigned, _ = inputs.assigned_items(spark, sf_dir)
    tables = lookups.token_lookups(assigned, ("phash_to_key", "key_to_cluster"))
    kept = {n: store.save(t, store.cluster_path(n)) for n, t in tables.items()}
    return (
        kept["phash_to_key"].join(kept["key_to_cluster"], "image_id")
        .select("token", "image_id", "cluster_id")
    )


@query("asset_key")
def asset_key_query(spark, sf_dir):
    pages = inputs.table(spark, sf_dir, "pages")
    return pages.select("page_id", asset_key(F.col("url")).alias("asset_key"))


@query("random_pairs")
def random_pairs(spark, sf_dir):
    orders = inputs.table(spark, sf_dir, "orders")
    pairs = explore.random_pairs_for(orders, "o_orderkey")
    return pairs.select("o_orderkey", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query("reuse_measures")
def reuse_measures(spark, sf_dir):
    store = _store(spark, replace(SETTINGS, candidate_has_mapped=True))
    path = store.candidate_path("measures")
    store.save(inputs.describe(inputs.fuzzy_images(spark, sf_dir)), path)
    again = candidate_measures(store, store.config, None, path)
    return again.select("image_id", F.explode("phash").alias("token"))


# --- measures ----------------------------------------------------------------


def _pixels(selected: DataFrame) -> DataFrame:
    """image_id, sel_id, is_full, width, height, pos, v of single-band selections."""
    band = F.get(F.col("bands"), F.lit(0))
    return selected.select(
        "image_id", "sel_id", "is_full", "width", "height", F.posexplode(band).alias("pos", "v")
    )


@query("select_full")
def select_full(spark, sf_dir):
    return _pixels(selections.select_full(inputs.gray_images(spark, sf_dir)))


@query("select_patches")
def select_patches(spark, sf_dir):
    return _pixels(selections.select_patches(inputs.gray_images(spark, sf_dir)))


@query("select_quadrants")
def select_quadrants(spark, sf_dir):
    return _pixels(selections.select_quadrants(inputs.rgb_images(spark, sf_dir)))


@query("to_rgb")
def to_rgb(spark, sf_dir):
    """Images of one to four bands in turn."""
    last = (F.col("image_id") % 4).cast("int")
    turned = F.transform(F.sequence(F.lit(0), last), lambda i: inputs.rotated(F.col("e"), i * 16))
    images = inputs.vectors(spark, sf_dir).select("image_id", turned.alias("bands"))
    rows = selections.to_rgb(images).select("image_id", F.posexplode("bands").alias("band", "b"))
    return rows.select("image_id", "band", F.posexplode("b").alias("pos", "v"))


@query("resize")
def resize(spark, sf_dir):
    whole = selections.select_full(inputs.rgb_images(spark, sf_dir))
    small = selections.resize(whole, 5)
    rows = small.select("image_id", "width", "height", F.posexplode("bands").alias("band", "b"))
    rows = rows.select("image_id", "width", "height", "band", F.posexplode("b").alias("pos", "v"))
    return rows.withColumn("v", tidy("v"))


def _gray(spark, sf_dir) -> DataFrame:
    return selections.to_rgb(selections.select_full(inputs.gray_images(spark, sf_dir)))


def _rgb(spark, sf_dir) -> DataFrame:
    return selections.select_full(inputs.rgb_images(spark, sf_dir))


@query("band_percentiles")
def band_percentiles(spark, sf_dir):
    rows = measures.band_percentiles(_rgb(spark, sf_dir), QUANTILES)
    return values_at(rows, "histo", "image_id")


@query("luminosity")
def luminosity_query(spark, sf_dir):
    rows = _rgb(spark, sf_dir).withColumn("lum", luminosity(F.col("bands")))
    return values_at(rows, "lum", "image_id")


@query("phash_bits")
def phash_bits(spark, sf_dir):
    return measures.phash_bits(_gray(spark, sf_dir)).select("image_id", "bits")


@query("phash_blocks")
def phash_blocks(spark, sf_dir):
    rows = measures.phash_tokens(_gray(spark, sf_dir), inputs.PHASH_BITS)
    return rows.select("image_id", F.posexplode("phash").alias("pos", "token"))


@query("phash_ngrams")
def phash_ngrams(spark, sf_dir):
    rows = measures.phash_tokens(_gray(spark, sf_dir), inputs.PHASH_BITS)
    return measures.ngram_rows(rows, "phash", inputs.NGRAM, "image_id")


@query("word_ngrams")
def word_ngrams(spark, sf_dir):
    """Counts of the word n-grams of every document."""
    documents = inputs.table(spark, sf_dir, "documents")
    return measures.word_ngram_counts(documents, "text", 3, "doc_id")


@query("color_centroids")
def color_centroids(spark, sf_dir):
    rows = measures.color_centroids(_rgb(spark, sf_dir), 3, 2)
    return values_at(rows, "cen", "image_id")


@query("pixel_covariance")
def pixel_covariance(spark, sf_dir):
    rows = measures.pixel_covariance(inputs.line_pixels(spark, sf_dir), "image_id")
    return rows.select(
        "image_id", "n", *[tidy(c, 5).alias(c) for c in ("xx", "xy", "xz", "yy", "yz", "zz")]
    )


@query("pca_measures")
def pca_measures(spark, sf_dir):
    """Variances, and how far the components are from unit eigenvectors."""
    rows = measures.pixel_covariance(inputs.line_pixels(spark, sf_dir), "image_id")
    rows = measures.pca_measures(measures.as_covariance(rows))
    m = {c: F.col(f"cov.{c}") for c in ("xx", "xy", "xz", "yy", "yz", "zz")}
    lines = (("xx", "xy", "xz"), ("xy", "yy", "yz"), ("xz", "yz", "zz"))
    at = lambda i: F.get(F.col("pca_fac"), F.lit(i))
    off, norm = [], []
    for k in range(3):
        v = [at(3 * k + j) for j in range(3)]
        norm.append(F.abs(v[0] * v[0] + v[1] * v[1] + v[2] * v[2] - 1))
        for i, line in enumerate(lines):
            av = reduce(lambda a, b: a + b, [m[c] * x for c, x in zip(line, v)])
            off.append(F.abs(av - F.get(F.col("pca_var"), F.lit(k)) * v[i]))
    return rows.select(
        "image_id",
        *[tidy(F.get(F.col("pca_var"), F.lit(i)), 5).alias(f"var{i}") for i in range(3)],
        tidy(F.greatest(*off), 5).alias("off_axis"),
        tidy(F.greatest(*norm), 5).alias("off_length"),
    )


@query("region_tokens")
def region_tokens_query(spark, sf_dir):
    small = selections.resize(_rgb(spark, sf_dir), 4)
    rows = region_tokens(small, 5)
    return rows.select("image_id", F.posexplode("ward").alias("region", "token"))


@query("feature_vector")
def feature_vector(spark, sf_dir):
    whole = _rgb(spark, sf_dir)
    rows = measures.band_percentiles(measures.color_centroids(whole, 3, 1), QUANTILES)
    return values_at(measures.feature_vector(rows), "features", "image_id")


@query("measure_images")
def measure_images_query(spark, sf_dir):
    rows = measure_images(inputs.byte_images(spark, sf_dir), SMALL)
    return rows.select(
        "image_id",
        "sel_id",
        "is_full",
        F.size("features").alias("n_features"),
        F.size("phash").alias("n_phash"),
        F.size("ward").alias("n_ward"),
        F.size("pca_fac").alias("n_factors"),
        vector_text(F.col("histo")).alias("histo"),
    )


# --- clustering --------------------------------------------------------------


@query("project_measures")
def project_measures(spark, sf_dir):
    items = cluster.project_measures(inputs.known_items(spark, sf_dir))
    return items.select(
        "image_id",
        vector_text(F.col("features")).alias("features"),
        F.array_join("phash", ",").alias("phash"),
        F.array_join("ward", ",").alias("ward"),
    )


@query("seed_sample")
def seed_sample(spark, sf_dir):
    return cluster.seed_sample(inputs.known_items(spark, sf_dir), inputs.CLUSTERS).select(
        "image_id", "draw", vector_text(F.col("features")).alias("features")
    )


def _seeds(spark, sf_dir):
    items = inputs.known_items(spark, sf_dir)
    rows = cluster.seed_sample(items, inputs.CLUSTERS).select("features").collect()
    return items, [r[0] for r in rows]


@query("nearest_center")
def nearest_center(spark, sf_dir):
    items, points = _seeds(spark, sf_dir)
    return cluster.nearest_center(items, points).select(
        "image_id", "cluster_id", tidy("distance").alias("distance")
    )


@query("lloyd_step")
def lloyd_step(spark, sf_dir):
    items, points = _seeds(spark, sf_dir)
    return values_at(cluster.lloyd_step(items, points), "center", "cluster_id", "n")


@query("cluster_items")
def cluster_items(spark, sf_dir):
    _, fit = inputs.fitted(spark, sf_dir)
    return values_at(fit.centers, "center", "cluster_id", "n")


@query("center_shift")
def center_shift(spark, sf_dir):
    _, fit = inputs.fitted(spark, sf_dir)
    return fit.fit_stats.select("rounds", tidy("shift").alias("shift"))


@query("within_sse")
def within_sse(spark, sf_dir):
    items, fit = inputs.fitted(spark, sf_dir)
    return cluster.within_sse(items, fit.points).select("n", tidy("sse", 5).alias("sse"))


@query("cluster_token_counts")
def cluster_token_counts(spark, sf_dir):
    return inputs.token_counts(inputs.assigned_items(spark, sf_dir)[0])


@query("cluster_top_tokens")
def cluster_top_tokens(spark, sf_dir):
    counts = inputs.token_counts(inputs.assigned_items(spark, sf_dir)[0])
    return cluster.cluster_top_tokens(counts, "ward", 0, 20)


@query("token_cap")
def token_cap(spark, sf_dir):
    counts = inputs.token_counts(inputs.assigned_items(spark, sf_dir)[0])
    return cluster.token_cap(counts, TOKEN_CAPS)


@query("token_heavy_hitters")
def token_heavy_hitters(spark, sf_dir):
    assigned, _ = inputs.assigned_items(spark, sf_dir)
    return cluster.token_heavy_hitters(assigned, "ward", 10)


@query("fit_meta")
def fit_meta(spark, sf_dir):
    _, fit = inputs.fitted(spark, sf_dir)
    value = lambda c: F.col(c).cast("double")
    sizes = fit.centers.select(F.lit("n").alias("name"), "cluster_id", value("n").alias("value"))
    facts = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.lit(-1).alias("cluster_id"), v.alias("value"))
            for name, v in (
                ("rounds", value("rounds")), ("shift", tidy("shift")), ("sse", tidy("sse", 5))
            )
        ]
    )
    return sizes.unionByName(fit.fit_stats.select(F.inline(facts)))


@query("token_lookups")
def token_lookups(spark, sf_dir):
    """Rows of each of the fourteen tables."""
    assigned, _ = inputs.assigned_items(spark, sf_dir)
    counts = [
        table.agg(F.lit(name).alias("table_name"), F.count("*").alias("n"))
        for name, table in lookups.token_lookups(assigned).items()
    ]
    return reduce(DataFrame.unionByName, counts)


def _lookup_query(name: str):
    def run(spark, sf_dir):
        assigned, _ = inputs.assigned_items(spark, sf_dir)
        table = lookups.token_lookup(assigned, name, inputs.NGRAM)
        if "features" in table.columns:
            table = table.withColumn("features", vector_text(F.col("features")))
        return table

    run.__name__ = name
    return run


for _name in LOOKUP_TABLES:
    QUERIES[_name] = _lookup_query(_name)


# --- search ------------------------------------------------------------------


def _by_kind(parts: dict[str, DataFrame]) -> DataFrame:
    return votes.tagged(parts)


def _prepared(spark, sf_dir):
    """Known items with clusters, their token counts, centres, candidates."""
    assigned, fit = inputs.assigned_items(spark, sf_dir)
    assigned = cut_lineage(assigned)
    cands = cut_lineage(inputs.candidates(spark, sf_dir))
    return assigned, inputs.token_counts(assigned), fit.points, cands


def _matches(spark, sf_dir, mode: str = "weighted") -> Matches:
    assigned, counts, points, cands = _prepared(spark, sf_dir)
    return find_similar(assigned, counts, points, cands, replace(SETTINGS, vote_mode=mode))


@query("cluster_token_score")
def cluster_token_score(spark, sf_dir):
    _, counts, _, cands = _prepared(spark, sf_dir)
    return _by_kind({k: search.cluster_token_score(cands, counts, k) for k in cluster.KINDS})


@query("best_cluster_by_token")
def best_cluster_by_token(spark, sf_dir):
    _, counts, _, cands = _prepared(spark, sf_dir)
    return _by_kind(
        {
            k: search.best_cluster_by_token(cands, search.cluster_token_score(cands, counts, k))
            for k in cluster.KINDS
        }
    )


@query("best_cluster_by_distance")
def best_cluster_by_distance(spark, sf_dir):
    _, _, points, cands = _prepared(spark, sf_dir)
    return search.best_cluster_by_distance(cands, points).withColumn("distance", tidy("distance"))


@query("assign_clusters")
def assign_clusters(spark, sf_dir):
    picked = _matches(spark, sf_dir).assigned
    return picked.select("cand", "sel_id", "pick", "cluster_id", tidy("distance").alias("distance"))


@query("sort_by_distance")
def sort_by_distance(spark, sf_dir):
    picked = search.sort_by_distance(_matches(spark, sf_dir).assigned)
    return picked.select("cand", "pick", tidy("distance").alias("distance"))


@query("candidate_tokens")
def candidate_tokens(spark, sf_dir):
    picked = _matches(spark, sf_dir).assigned
    return _by_kind(
        {k: search.candidate_tokens(picked, k, inputs.NGRAM) for k in cluster.KINDS}
    )


@query("join_on_cluster")
def join_on_cluster(spark, sf_dir):
    return _by_kind(_matches(spark, sf_dir).cand_tokens)


@query("join_token_key")
def join_token_key(spark, sf_dir):
    found = _matches(spark, sf_dir)
    return _by_kind(
        {
            k: search.token_pairs(found.cand_tokens[k], found.known_tokens[k], "n_b")
            for k in cluster.KINDS
        }
    )


@query("vote_counts")
def vote_counts(spark, sf_dir):
    found = _matches(spark, sf_dir)
    return _by_kind({k: found.votes(k) for k in cluster.KINDS})


@query("best_with_total")
def best_with_total(spark, sf_dir):
    found = _matches(spark, sf_dir)
    return _by_kind({k: found.best(k) for k in cluster.KINDS})


@query("final_matches")
def final_matches(spark, sf_dir):
    return _matches(spark, sf_dir).joined()


@query("fused_votes")
def fused_votes(spark, sf_dir):
    return _matches(spark, sf_dir).fused()


@query("match_pairs")
def match_pairs(spark, sf_dir):
    """Vectors of candidate and best match side by side."""
    best = plain_best(spark, sf_dir)
    mine, theirs = [
        f(spark, sf_dir).select(
            "image_id", vector_text(F.get(F.col("bands"), F.lit(0))).alias("content")
        )
        for f in (inputs.fuzzy_images, inputs.gray_images)
    ]
    return search.match_pairs(best, mine, theirs, "content")


@query("match_samples")
def match_samples(spark, sf_dir):
    joined = _matches(spark, sf_dir).joined()
    return search.match_samples(joined, SETTINGS.search_sample_step, "cand")


@query("find_similar")
def find_similar_query(spark, sf_dir):
    return _all_matches(spark, sf_dir, "weighted")


@query("find_similar_strict")
def find_similar_strict(spark, sf_dir):
    return _all_matches(spark, sf_dir, "strict")


def _all_matches(spark, sf_dir, mode):
    found = _matches(spark, sf_dir, mode)
    fused = found.fused().select(
        "cand",
        F.col("best_match").alias("fused_best"),
        F.col("agree_count").alias("fused_votes"),
        F.col("total").alias("fused_total"),
    )
    return found.joined().join(fused, "cand")


def _plain_tokens(spark, sf_dir, kind="phash"):
    """Token rows of candidates and of known items, without clusters."""
    tokens = token_ngrams(F.col("phash"), inputs.NGRAM) if kind == "phash" else F.col(kind)
    return (
        inputs.candidates(spark, sf_dir).select("cand", F.explode(tokens).alias("token")),
        inputs.known_items(spark, sf_dir).select("image_id", F.explode(tokens).alias("token")),
    )


def plain_best(spark, sf_dir) -> DataFrame:
    """For each altered picture: the original with most n-grams in common."""
    return votes.best_with_total(*_plain_tokens(spark, sf_dir))


@query("nearest_original")
def nearest_original(spark, sf_dir):
    return plain_best(spark, sf_dir)


@query("search_rounds")
def search_rounds(spark, sf_dir):
    return search.search_rounds(*_plain_tokens(spark, sf_dir), rounds=2)


@query("token_pair_join")
def token_pair_join(spark, sf_dir):
    return search.token_pairs(*_plain_tokens(spark, sf_dir, "ward"))


@query("token_pair_groups")
def token_pair_groups(spark, sf_dir):
    return search.token_pair_groups(*_plain_tokens(spark, sf_dir, "ward"))


@query("outer_token_groups")
def outer_token_groups(spark, sf_dir):
    return search.outer_token_groups(*_plain_tokens(spark, sf_dir, "ward"))


@query("cluster_neighbors")
def cluster_neighbors(spark, sf_dir):
    assigned, _, points, cands = _prepared(spark, sf_dir)
    return search.cluster_neighbors(cands, points, assigned)


# --- altered copies ----------------------------------------------------------


@query("block_median_fuzz")
def block_median_fuzz_query(spark, sf_dir):
    fuzzy = block_median_fuzz(
        inputs.gray_images(spark, sf_dir),
        inputs.FUZZ_BLOCK,
        inputs.FUZZ_PROBABILITY,
        inputs.FUZZ_SEED,
    )
    return fuzzy.select("image_id", F.posexplode(F.get(F.col("bands"), F.lit(0))).alias("pos", "v"))


# --- exploration -------------------------------------------------------------


def _line_pairs(spark, sf_dir):
    return inputs.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), F.col("l_discount").alias("y")
    )


@query("map_products")
def map_products(spark, sf_dir):
    rows = explore.map_products(_line_pairs(spark, sf_dir), "l_orderkey", "l_linenumber")
    return rows.select(
        "l_orderkey", "l_linenumber", *[tidy(c).alias(c) for c in ("xx", "yy", "xy")]
    )


@query("moment_ratio")
def moment_ratio(spark, sf_dir):
    row = explore.moment_ratio(_line_pairs(spark, sf_dir))
    return row.select(tidy(F.col("ratio") * 1e6).alias("ratio_e6"), tidy("correlation").alias("correlation"))


@query("word_count")
def word_count(spark, sf_dir):
    return explore.word_count(inputs.table(spark, sf_dir, "documents"))


@query("row_count")
def row_count(spark, sf_dir):
    return explore.row_count(inputs.table(spark, sf_dir, "documents"))


@query("take_rows")
def take_rows(spark, sf_dir):
    orders = inputs.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return explore.take_rows(orders, 10, "o_orderkey")


@query("inspect_type")
def inspect_type(spark, sf_dir):
    return explore.inspect_type(inputs.table(spark, sf_dir, "documents"))


def _native_percentiles(spark, sf_dir) -> DataFrame:
    pixels = inputs.line_pixels(spark, sf_dir)
    return band_percentile_rows(pixels, ["image_id"], BUCKET_WIDTHS, NATIVE_QUANTILES)


@query("native_band_percentiles")
def native_band_percentiles(spark, sf_dir):
    rows = _native_percentiles(spark, sf_dir)
    return rows.select("image_id", "band", "q", tidy("pct", 9).alias("pct"))


@query("mean_of_percentiles")
def mean_of_percentiles(spark, sf_dir):
    rows = explore.mean_of_percentiles(_native_percentiles(spark, sf_dir))
    return rows.select("band", "q", tidy("mean_pct", 9).alias("mean_pct"))


@query("mean_color_bins")
def mean_color_bins(spark, sf_dir):
    return explore.mean_color_bins(inputs.line_pixels(spark, sf_dir), "image_id", ["r", "g", "b"])


def _medians(spark, sf_dir) -> DataFrame:
    histo = measures.band_percentiles(_rgb(spark, sf_dir), QUANTILES)
    return explore.histo_median(histo)


@query("histo_median")
def histo_median(spark, sf_dir):
    return _medians(spark, sf_dir).withColumn("median", tidy("median"))


@query("lowest_by_median")
def lowest_by_median(spark, sf_dir):
    rows = explore.lowest_by_median(_medians(spark, sf_dir))
    return rows.withColumn("median", tidy("median"))


def _join_query(left: str, how: str):
    def run(spark, sf_dir):
        a = inputs.table(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("k"), F.col("c_name").alias("a_name")
        )
        b = inputs.table(spark, sf_dir, "orders").select(
            F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("b_order")
        )
        first, second = (a, b) if left == "a" else (b, a)
        return explore.pair_join(first, second, "k", how)

    return run


for _name, _left, _how in (
    ("inner_join_ab", "a", "inner"),
    ("inner_join_ba", "b", "inner"),
    ("right_join_ab", "a", "right_outer"),
    ("left_join_ba", "b", "left_outer"),
    ("right_join_ba", "b", "right_outer"),
    ("left_join_ab", "a", "left_outer"),
    ("full_join_ab", "a", "full_outer"),
):
    QUERIES[_name] = _join_query(_left, _how)


# --- whole runs --------------------------------------------------------------


@query("run_actions")
def run_actions_query(spark, sf_dir):
    """Pictures and their altered copies as files, through all three steps."""
    originals = inputs.byte_images(spark, sf_dir)
    copies = block_median_fuzz(originals, 2, whole_numbers=True)
    config = replace(
        SMALL, root=fresh_dir(spark, "run"), input_glob="*.png", candidate_glob="*.png",
        max_patches=0,
    )
    run_actions(spark, config, _png_folder(spark, originals), _png_folder(spark, copies))
    store = RunStore(spark, config)
    joined = store.load(store.candidate_path("joined_final_matches"))
    name = lambda c: image_name(F.col(c)).alias(c)
    return joined.select(
        name("cand"), name("ward_best"), "ward_votes", "ward_total",
        name("phash_best"), "phash_votes", "phash_total",
    )

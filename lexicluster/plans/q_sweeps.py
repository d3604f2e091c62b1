"""Queries: sweeps over parts that exist (PIPE-5…8, PIPE-10, PIPE-11).  Each run's trials are scored
against the labels, summarised (AGG-7) and appended as a result line (SNK-4); the query reads the
lines back."""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import clustering as C
from ..operators import deep as DP
from ..operators import features as feats
from ..operators import metrics as M
from ..operators import training as TR
from ..operators import windows as W
from ..operators.experiments import trial_summary
from ..operators.filters import drop_empty_docs, filter_available_variants, filter_vocab_tokens
from ..operators.kmeans_runs import kmeans_runs
from ..operators.topics import gsdmm_runs
from ..session import checkpoint, shared_path
from ..sources import readers as R
from ..sources import writers as S
from . import fixtures as fx
from .flagship import kmeans_trials
from .q_pipelines import TRANSFORMS
from .registry import register

SUMMARY = ["best_acc", "best_nmi", "best_ari", "acc_mean", "acc_std", "nmi_mean", "nmi_std", "ari_mean", "ari_std"]


class Results:
    """Result lines of one sweep.  A run is counted as it comes, at most K² cells a trial; all runs are scored together."""

    def __init__(self, spark, corpora: str):
        self.spark, self.corpora, self.path = spark, corpora, shared_path(spark, "sweep")
        self.runs, self.cells = [], []

    def add(self, preds, feat_name: str, n_topics: int) -> None:
        """Count (trial, label, pred) of a run."""
        self.cells.append(M.contingency_table(preds, by=["trial"]).toArrow())
        self.runs.append((len(self.runs), feat_name, n_topics))

    def lines(self):
        """Score the trials, append the runs' lines and read them back."""
        runs = self.spark.createDataFrame(self.runs, "run int, feat_name string, n_topics int")
        s = trial_summary(M.cluster_scores(M.counted_cells(self.spark, self.cells), by=["run", "trial"]), ["run"])
        s = s.withColumnsRenamed({"best_ami": "best_ari", "ami_mean": "ari_mean", "ami_std": "ari_std"})
        s = runs.join(F.broadcast(s), "run").coalesce(1)                   # a row a run
        S.append_run_result(s.select(F.lit(self.corpora).alias("corpora"), "feat_name", "n_topics", *SUMMARY), self.path)
        lines = R.scan_result_files(self.spark, self.path + "/*/*.json", base_path=self.path)
        return lines.select("corpora", "feat_name", "n_topics", *[F.round(c, 6).alias(c) for c in SUMMARY])


def topic_model_clustering(spark, sf_dir, topics=(30, 40, 50), n_trials: int = 10, max_iter: int = 50, k: int = 4, n_init: int = 10):
    """PIPE-6: count features → LDA with each number of topics, one fit a trial (the trials share the passes); the
    most likely topic, and k-means on the topic distributions, as clusters."""
    tok = fx.tokens(spark, sf_dir)
    counts = feats.count_vectors(tok, feats.fit_vocabulary(tok, 2000), "tokens", "counts").where(F.size("tokens") > 0).select("doc_id", "label", "counts").persist()
    out = Results(spark, "documents")
    for n in topics:
        by_topic = by_kmeans = None
        for t, fit in enumerate(C.lda_cluster_runs(counts, n, "counts", range(n_trials), max_iter)):
            theta = fit.select("doc_id", "label", "theta", "pred").persist()
            a = theta.select(F.lit(t).alias("trial"), "label", F.col("pred").cast("int").alias("pred"))
            b = kmeans_trials(theta.select("doc_id", "label", "theta"), k, 1, n_init, "doc_id", "theta", dim=n, seed=t).select(F.lit(t).alias("trial"), "label", "pred")
            a, b = checkpoint(a), checkpoint(b)
            theta.unpersist()
            by_topic, by_kmeans = (a, b) if by_topic is None else (by_topic.union(a), by_kmeans.union(b))
        out.add(by_topic, f"lda_cluster_{n}", k)
        out.add(by_kmeans, f"lda_kmeans_{n}", k)
    counts.unpersist()
    return out.lines()


@register("topic_model_clustering")
def q_topic_models(spark, sf_dir):
    """PIPE-6 with 30, 40 and 50 topics, 50 iterations and 10 trials."""
    return topic_model_clustering(spark, sf_dir)


def gsdmm_sweep_run(spark, sf_dir, n_clusters: int = 4, n_trials: int = 10, iters: int = 10, max_topic: int = 30):
    """PIPE-7: tokens of the 2,000 most frequent terms, documents without one dropped, written as JSON lines
    and scanned again; then GSDMM for every number of clusters from n to min(30, 2n) − 1, all numbers and
    trials in the same passes."""
    tok = fx.tokens(spark, sf_dir)
    vocab = feats.fit_vocabulary(tok, 2000)
    kept = drop_empty_docs(filter_vocab_tokens(tok, "tokens", vocab.terms), "tokens")
    path = shared_path(spark, "gsdmm-corpus")
    S.write_json_corpus(kept.select(F.array_join("tokens", " ").alias("text"), F.col("label").alias("cluster")), path)
    docs = R.scan_json_corpus(spark, path).select(F.monotonically_increasing_id().alias("doc_id"), F.col("cluster").alias("label"), F.split("text", " ").alias("tokens"))
    docs = checkpoint(feats.word_indices(docs, vocab, ["doc_id", "label"]))
    Ks = list(range(n_clusters, min(max_topic, 2 * n_clusters)))
    z = gsdmm_runs(docs.select("doc_id", "words"), [K for K in Ks for _ in range(n_trials)], len(vocab.terms), iters=iters)
    z = checkpoint(z.join(docs.select("doc_id", "label"), "doc_id"))
    out = Results(spark, "documents")
    for i, K in enumerate(Ks):
        runs = z.select("label", F.posexplode(F.slice("z", i * n_trials + 1, n_trials)).alias("trial", "pred"))
        out.add(runs, "gsdmm", K)
    return out.lines()


@register("gsdmm_sweep_run")
def q_gsdmm_sweep_run(spark, sf_dir):
    """PIPE-7: corpus and sweep, 10 trials, 10 sweeps each."""
    return gsdmm_sweep_run(spark, sf_dir)


@register("autoencoder_feature_kmeans")
def q_ae_kmeans(spark, sf_dir):
    """PIPE-5: of the feature transforms (identity, layer norm, L2) those with a stored network (FLT-9;
    two are trained and stored here) are encoded and clustered, 10 trials of 10 restarts."""
    f = fx.feat(spark, sf_dir).withColumnRenamed("vec_id", "id")
    base = shared_path(spark, "networks")
    for name in ("i", "norm"):
        d = f.select("id", TRANSFORMS[name]("x").alias("x")).persist()
        TR.autoencoder_pretrain(d, [64, 32, 10], epochs=4, final_epochs=4, lr=1.0, path=f"{base}/embeddings_{name}")
        d.unpersist()
    variants = spark.createDataFrame([("embeddings", n) for n in TRANSFORMS], "feat_name string, transform string")
    stored = spark.createDataFrame([("embeddings", "i"), ("embeddings", "norm")], "feat_name string, transform string")
    out = Results(spark, "embeddings")
    for r in sorted(filter_available_variants(variants, stored, ["feat_name", "transform"]).collect()):
        net = DP.network_from_table(spark.read.parquet(f"{base}/{r['feat_name']}_{r['transform']}/final"))
        d = f.select("id", "label", TRANSFORMS[r["transform"]]("x").alias("x"))
        h = DP.autoencoder_encode(d, net, "x", "x2", ["id", "label"]).withColumnRenamed("x2", "x").persist()
        preds = kmeans_trials(h, fx.N_LABELS, 10, 10, "id", "x", seed=3)
        out.add(preds, f"embeddings_{r['transform']}", fx.N_LABELS)
        preds.unpersist()
        h.unpersist()
    return out.lines()


@register("cluster_number_sweep")
def q_cluster_numbers(spark, sf_dir):
    """PIPE-8: k = n, n + 2, …, 30 on the embeddings, 10 trials of 10 restarts each."""
    d = fx.feat(spark, sf_dir).select(F.col("vec_id").alias("id"), "label", "x").persist()
    out = Results(spark, "embeddings")
    for k in range(fx.N_LABELS, 31, 2):
        preds = kmeans_trials(d, k, 10, 10, "id", "x", seed=k)
        out.add(preds, "embeddings_i", k)
        preds.unpersist()
    d.unpersist()
    return out.lines()


def dec_against_idec(spark, sf_dir, n_trials: int = 10, max_steps: int = 20, update_interval: int = 10):
    """PIPE-10: IDEC and DEC (without the reconstruction term) from the same pretrained network, trials from
    different k-means starts."""
    f = fx.feat(spark, sf_dir).withColumnRenamed("vec_id", "id").persist()
    net = TR.autoencoder_pretrain(f, [64, 32, 10], epochs=4, final_epochs=4, lr=1.0)
    h = DP.autoencoder_encode(f, net, "x", "h", ["id"]).persist()
    Cs, inertia, _ = kmeans_runs(h, fx.N_LABELS, 20 * n_trials, "id", "h", seed=0)
    starts = [Cs[20 * t + int(np.argmin(inertia[20 * t:20 * t + 20]))] for t in range(n_trials)]
    h.unpersist()
    out = Results(spark, "embeddings")
    for use_ae, name in ((True, "IDEC"), (False, "DEC")):
        every = None
        for t, (fitted, c1) in enumerate(DP.idec_runs(f, net, starts, max_steps=max_steps, update_interval=update_interval, use_ae=use_ae)):
            hidden = DP.autoencoder_encode(f, fitted, "x", "h", ["id", "label"])
            p = C.assign_nearest(hidden, c1.tolist(), "h", "pred").select(F.lit(t).alias("trial"), "label", "pred")
            every = p if every is None else every.union(p)
        out.add(every, name, fx.N_LABELS)
    f.unpersist()
    return out.lines()


@register("dec_against_idec")
def q_dec_against_idec(spark, sf_dir):
    """PIPE-10: 10 trials of 20 steps each, all trials of a method in the same passes."""
    return dec_against_idec(spark, sf_dir)


def dcn_over_seeds(spark, sf_dir, seeds=range(20), epochs: int = 5):
    """PIPE-11: DCN from k-means on the codes, and seeded DCN from the centroids of ten seeds per label,
    once for each random seed (network, permutations and seed rows)."""
    f = fx.feat(spark, sf_dir).withColumnRenamed("vec_id", "id").persist()
    out = Results(spark, "embeddings")
    every = {"DCN": None, "seed_DCN": None}
    for t, seed in enumerate(seeds):
        net = DP.autoencoder([64, 32, 8], seed=seed)
        h = DP.autoencoder_encode(f, net, "x", "h", ["id"]).persist()
        Cs, inertia, _ = kmeans_runs(h, fx.N_LABELS, 20, "id", "h", seed=seed)
        picked = checkpoint(W.select_seeds(f.select("id", "label"), "id", "label", 10, seed))
        own = C.centers_to_list(C.label_centroids(h.join(picked, "id"), fx.N_LABELS, "h", "label"), fx.N_LABELS)
        for name, c0, pinned in (("DCN", Cs[int(np.argmin(inertia))].tolist(), None), ("seed_DCN", own, picked)):
            _, _, pred = TR.dcn_fit(f, net, c0, epochs=epochs, lr=0.05, seeds=pinned, shuffle=True, count_epoch=1, init_num=-1, seed=seed)
            p = checkpoint(pred.join(f.select("id", "label"), "id").select(F.lit(t).alias("trial"), "label", "pred"))
            every[name] = p if every[name] is None else every[name].union(p)
        h.unpersist()
    for name, preds in every.items():
        out.add(preds, name, fx.N_LABELS)
    f.unpersist()
    return out.lines()


@register("dcn_over_seeds")
def q_dcn_over_seeds(spark, sf_dir):
    """PIPE-11 over 2 random seeds and 2 epochs (the operator's defaults are 20 and 5)."""
    return dcn_over_seeds(spark, sf_dir, seeds=(101, 202), epochs=2)

"""Deep-clustering objectives on DataFrames (ML-14, ML-15, ML-18…23, AGG-11, EVAL-13)."""
from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vector_sum(df: DataFrame, col: str) -> list[float]:
    """Σ of an ARRAY<DOUBLE> column over all rows (one vectorised partial aggregate)."""
    r = df.select(array_to_vector(F.col(col)).alias("_v")).agg(
        Summarizer.sum(F.col("_v")).alias("s")).select(vector_to_array("s").alias("s")).first()
    return list(r["s"]) if r and r["s"] is not None else []


def soft_cluster_mass(df: DataFrame, q_col: str = "q") -> list[float]:
    """AGG-11: f_j = Σ_i q_ij (K values)."""
    return vector_sum(df, q_col)


# ====================================================================== network engine
#
# A dense network is a list of layers (W: out×in, b: out).  Parameters travel to the tasks as a
# broadcast; each task runs forward/backward on its Arrow batches with NumPy and emits partial
# gradient sums cut into chunks; one aggregation keyed by (parameter, chunk) adds them up, so the
# reduction is spread over many reducers even for large layers.  The driver applies the optimiser.

import numpy as np  # noqa: E402
import pandas as pd  # noqa: E402

GRAD_CHUNK = 65536


def tiny_network(dims, rule=lambda i, j: ((i * 31 + j * 17) % 13 - 6) / 10.0):
    """Deterministic weights by a rule (the fixed-network fixture): W[j][i] = rule(i, j), bias 0."""
    layers = []
    for a, b in zip(dims[:-1], dims[1:]):
        W = np.array([[rule(i, j) for i in range(a)] for j in range(b)], dtype=np.float64)
        layers.append((W, np.zeros(b)))
    return layers


def init_network(dims, seed: int = 0):
    """Uniform(±1/√in) initialisation (the usual default for dense layers)."""
    rng = np.random.default_rng(seed)
    out = []
    for a, b in zip(dims[:-1], dims[1:]):
        lim = 1.0 / np.sqrt(a)
        out.append((rng.uniform(-lim, lim, (b, a)), rng.uniform(-lim, lim, b)))
    return out


def autoencoder(dims, seed: int = 0):
    """Encoder dims[0]→…→dims[-1] and mirrored decoder; ReLU on every layer but the last of each."""
    return {"enc": init_network(dims, seed), "dec": init_network(list(reversed(dims)), seed + 1)}


def _forward(layers, X, keep=None):
    acts = [X]
    h = X
    for li, (W, b) in enumerate(layers):
        z = h @ W.T + b
        h = np.maximum(z, 0.0) if li < len(layers) - 1 else z
        acts.append(h)
    return acts


def _backward(layers, acts, dout):
    """Gradients of Σ(dout · output) w.r.t. every (W, b); returns (grads, d_input)."""
    grads = [None] * len(layers)
    d = dout
    for li in range(len(layers) - 1, -1, -1):
        W, _ = layers[li]
        if li < len(layers) - 1:
            d = d * (acts[li + 1] > 0)
        grads[li] = (d.T @ acts[li], d.sum(0))
        d = d @ W
    return grads, d


def encode_matrix(net, X):
    return _forward(net["enc"], X)[-1]


def _flatten(arrs):
    return np.concatenate([a.ravel() for a in arrs]) if arrs else np.zeros(0)


def _params(net):
    return [a for part in ("enc", "dec") for (W, b) in net[part] for a in (W, b)] if isinstance(net, dict) else \
        [a for (W, b) in net for a in (W, b)]


def _unflatten_like(flat, like):
    out, o = [], 0
    for a in like:
        out.append(flat[o:o + a.size].reshape(a.shape))
        o += a.size
    return out


def distributed_gradient(df: DataFrame, x_col: str, state, batch_fn, id_col: str = "id",
                         extra_cols=()) -> tuple[np.ndarray, float, int]:
    """Σ over rows of ``batch_fn(state, X, ids[, extra]) -> (flat_grad, loss_sum)``; returns
    (grad, loss, n).  ``extra_cols`` (per-row targets such as pseudo labels) travel with the rows."""
    extra_cols = list(extra_cols)
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast(state)

    def part(it):
        g, loss, n = None, 0.0, 0
        for pdf in it:
            if pdf.empty:
                continue
            X = np.vstack(pdf[x_col].to_numpy()).astype(np.float64)
            if extra_cols:
                gg, ll = batch_fn(bc.value, X, pdf[id_col].to_numpy(), pdf[extra_cols])
            else:
                gg, ll = batch_fn(bc.value, X, pdf[id_col].to_numpy())
            g = gg if g is None else g + gg
            loss += ll
            n += len(X)
        if g is None:
            return
        chunks = [(i, g[o:o + GRAD_CHUNK]) for i, o in enumerate(range(0, len(g), GRAD_CHUNK))]
        yield pd.DataFrame({"chunk": [c for c, _ in chunks], "g": [v for _, v in chunks],
                            "loss": [loss] + [0.0] * (len(chunks) - 1), "n": [n] + [0] * (len(chunks) - 1)})

    from pyspark.ml.functions import array_to_vector as a2v
    rows = (df.select(id_col, x_col, *extra_cols).mapInPandas(part, "chunk int, g array<double>, loss double, n long")
              .withColumn("gv", a2v("g")).groupBy("chunk")
              .agg(Summarizer.sum(F.col("gv")).alias("g"), F.sum("loss").alias("loss"), F.sum("n").alias("n"))
              .select("chunk", vector_to_array("g").alias("g"), "loss", "n").collect())     # parameter-sized
    bc.unpersist()
    rows = sorted(rows, key=lambda r: r["chunk"])
    grad = np.concatenate([np.array(r["g"]) for r in rows]) if rows else np.zeros(0)
    return grad, float(sum(r["loss"] for r in rows)), int(sum(r["n"] for r in rows))


def map_rows(df: DataFrame, x_col: str, state, fn, out_col: str, keep) -> DataFrame:
    """Row-wise NumPy transform ``fn(state, X) -> M`` (one pass, no shuffle)."""
    bc = df.sparkSession.sparkContext.broadcast(state)
    keep = list(keep)
    sub = df.select(*dict.fromkeys([*keep, x_col]))
    schema = ", ".join(f"`{c}` {t}" for c, t in sub.dtypes if c in keep) + f", `{out_col}` array<double>"

    def go(it):
        for pdf in it:
            if pdf.empty:
                continue
            M = fn(bc.value, np.vstack(pdf[x_col].to_numpy()).astype(np.float64))
            out = pdf[keep].copy()
            out[out_col] = list(M)
            yield out

    return sub.mapInPandas(go, schema)


def autoencoder_encode(df: DataFrame, net, x_col: str = "x", out_col: str = "h", keep=("id",)) -> DataFrame:
    """ML-12: hidden vectors = encoder output (ReLU on all encoder layers but the last)."""
    return map_rows(df, x_col, net, encode_matrix, out_col, keep)


def _dropout_mask(shape, ids, seed, epoch, layer, rate):
    if rate <= 0:
        return None
    from .kmeans_runs import _uniform
    u = np.stack([_uniform(seed, epoch * 1000 + layer, j, ids) for j in range(shape[1])], 1)
    return (u >= rate) / (1.0 - rate)


def _ae_batch(state, X, ids):
    """MSE reconstruction loss (mean over all cells) of the full autoencoder; dropout on the input."""
    net, n_total, seed, epoch, rate = state
    Xin = X
    m = _dropout_mask(X.shape, ids, seed, epoch, 0, rate)
    if m is not None:
        Xin = X * m
    ea = _forward(net["enc"], Xin)
    da = _forward(net["dec"], ea[-1])
    R = da[-1]
    diff = R - X
    loss = float((diff ** 2).sum()) / (n_total * X.shape[1])
    dR = 2.0 * diff / (n_total * X.shape[1])
    gdec, dh = _backward(net["dec"], da, dR)
    genc, _ = _backward(net["enc"], ea, dh)
    flat = _flatten([a for (gw, gb) in genc for a in (gw, gb)] + [a for (gw, gb) in gdec for a in (gw, gb)])
    return flat, loss * len(X) / len(X)


def _apply_update(net, flat_step):
    params = _params(net)
    steps = _unflatten_like(flat_step, params)
    i = 0
    for part in ("enc", "dec"):
        new = []
        for (W, b) in net[part]:
            new.append((W - steps[i], b - steps[i + 1]))
            i += 2
        net[part] = new
    return net


def autoencoder_fit(df: DataFrame, dims, epochs: int = 50, lr: float = 0.1, momentum: float = 0.9,
                    x_col: str = "x", id_col: str = "id", seed: int = 0, dropout: float = 0.0, metrics=None):
    """ML-13 (end-to-end stage): full-batch synchronous SGD with Nesterov momentum on the MSE of a
    denoising autoencoder.  Each epoch is one distributed gradient pass; the result does not
    depend on the partitioning (with dropout masks hashed per row)."""
    data = df.select(id_col, x_col).persist()
    n = data.count()
    net = autoencoder(dims, seed)
    vel = np.zeros(sum(p.size for p in _params(net)))
    losses = []
    for ep in range(epochs):
        look = _apply_update({k: list(v) for k, v in net.items()}, momentum * vel)   # Nesterov look-ahead
        g, loss, _ = distributed_gradient(data, x_col, (look, n, seed, ep, dropout), _ae_batch, id_col)
        vel = momentum * vel + lr * g
        net = _apply_update(net, vel)
        losses.append(loss)
        if metrics is not None:
            metrics.append(("recons_loss", ep, loss))
    data.unpersist()
    return net, losses


def network_table(spark, net, stage: str = "final") -> DataFrame:
    """SNK-10 representation: (stage, part, layer, kind, rows, cols, values)."""
    rows = []
    for part in ("enc", "dec"):
        for li, (W, b) in enumerate(net[part]):
            rows.append((stage, part, li, "weight", int(W.shape[0]), int(W.shape[1]), W.ravel().tolist()))
            rows.append((stage, part, li, "bias", int(b.shape[0]), 1, b.tolist()))
    return spark.createDataFrame(rows, "stage string, part string, layer int, kind string, rows int, cols int, values array<double>")


def network_from_table(df: DataFrame):
    rows = df.collect()                                   # parameter-sized
    net = {"enc": {}, "dec": {}}
    for r in rows:
        a = np.array(r["values"]).reshape(r["rows"], r["cols"]) if r["kind"] == "weight" else np.array(r["values"])
        net[r["part"]].setdefault(r["layer"], {})[r["kind"]] = a
    return {p: [(v[i]["weight"], v[i]["bias"]) for i in sorted(v)] for p, v in net.items()}


# ====================================================================== DEC / IDEC / DCN

def soft_assign(H, C):
    d2 = (H * H).sum(1)[:, None] - 2 * H @ C.T + (C * C).sum(1)[None, :]
    u = 1.0 / (1.0 + np.maximum(d2, 0.0))
    s = u.sum(1, keepdims=True)
    return u, s, u / s


def target_from_q(q, mass):
    w = q * q / mass[None, :]
    return w / w.sum(1, keepdims=True)


def _dec_batch(state, X, ids, extra=None):
    """Closed-form gradient of mean BCE(q, p) w.r.t. the centres.  p is the row's stored target, or
    without one the target of the current q."""
    C, mass, n_total = state
    K = C.shape[0]
    u, s, q = soft_assign(X, C)
    p = np.vstack(extra["p"].to_numpy()) if extra is not None else target_from_q(q, mass)
    qc = np.clip(q, 1e-12, 1 - 1e-12)
    loss = float(-(p * np.log(qc) + (1 - p) * np.log(1 - qc)).sum()) / (n_total * K)
    g = (q - p) / (qc * (1 - qc)) / (n_total * K)
    coef = (g - (g * q).sum(1, keepdims=True)) / s * 2.0 * u * u         # n × K
    grad = coef.T @ X - coef.sum(0)[:, None] * C                          # Σ_i coef_ij (x_i − c_j)
    return grad.ravel(), loss


def dec_gradient(df: DataFrame, centers, x_col: str = "x", id_col: str = "id"):
    """Gradient and loss of the DEC objective at fixed centres (target p from the same q)."""
    C = np.asarray(centers, dtype=np.float64)
    q = map_rows(df, x_col, C, lambda Cs, X: soft_assign(X, Cs)[2], "q", [id_col])
    mass = np.array(soft_cluster_mass(q, "q"))
    n = df.count()
    g, loss, _ = distributed_gradient(df, x_col, (C, mass, n), _dec_batch, id_col)
    return g.reshape(C.shape), loss


def _adam(state, g, lr, b1=0.9, b2=0.999, eps=1e-8):
    m, v, t = state
    t += 1
    m = b1 * m + (1 - b1) * g
    v = b2 * v + (1 - b2) * g * g
    step = lr * (m / (1 - b1 ** t)) / (np.sqrt(v / (1 - b2 ** t)) + eps)
    return step, (m, v, t)


class FrozenTargets:
    """Rows (id, x, p, pred) of a refresh: target distribution and prediction of each row under each of the runs
    that train together, written to the shared folder, so that the steps up to the next refresh read the same p
    without a join.  A refresh reads the rows and their earlier predictions from the table before, which it replaces."""

    def __init__(self, data: DataFrame, x_col: str, id_col: str):
        self.rows, self.x_col, self.id_col, self.path = data.select(id_col, x_col), x_col, id_col, None

    def refresh(self, state, soft, runs: int = 1, kept=None) -> list:
        """Targets for ``soft(state, X)``, the soft assignments of ``runs`` runs side by side; the share of predictions
        that changed in each (None the first time).  ``kept``: the places that the runs had in the refresh before."""
        from ..session import remove_table, shared_path
        spark, keep = self.rows.sparkSession, [self.id_col, self.x_col] + (["pred"] if self.path else [])
        q = map_rows(self.rows.select(*keep), self.x_col, state, soft, "q", keep).persist()
        mass = np.array(soft_cluster_mass(q, "q"))
        k = len(mass) // runs

        def targets(m, Q):
            every = [Q[:, r * k:(r + 1) * k] for r in range(runs)]
            return np.hstack([target_from_q(Qr, m[r * k:(r + 1) * k]) for r, Qr in enumerate(every)] + [np.stack([Qr.argmax(1) for Qr in every], 1)])

        both = map_rows(q, "q", mass, targets, "_p", keep)
        last = F.col("pred") if self.path else F.lit(None).cast("array<int>")
        path, before = shared_path(spark, "targets"), self.path
        both.select(self.id_col, self.x_col, F.slice("_p", 1, runs * k).alias("p"), last.alias("last"),
                    F.slice("_p", runs * k + 1, runs).cast("array<int>").alias("pred")).write.parquet(path)
        q.unpersist()
        self.rows, self.path = spark.read.parquet(path), path
        if before is None:
            return [None] * runs
        remove_table(spark, before)
        return list(self.rows.agg(*[F.avg((F.col("pred")[r] != F.col("last")[at]).cast("double")) for r, at in enumerate(range(runs) if kept is None else kept)]).first())

    def drop(self) -> None:
        from ..session import remove_table
        if self.path:
            remove_table(self.rows.sparkSession, self.path)


def dec_refine(df: DataFrame, centers, max_steps: int = 20, update_interval: int = 10, tol: float = 1e-3,
               lr: float = 1e-3, x_col: str = "x", id_col: str = "id", metrics=None):
    """ML-14: start from k-means centres, Adam steps on the centres for mean BCE(q, p); p (and the
    predictions) are refreshed every ``update_interval`` steps and stay as they are in between;
    stop when the share of changed predictions falls below ``tol``.  Every step is one distributed
    pass."""
    n = df.count()
    C = np.asarray(centers, dtype=np.float64).copy()
    adam = (np.zeros_like(C), np.zeros_like(C), 0)
    target = FrozenTargets(df, x_col, id_col)
    for step in range(max_steps if n else 0):
        if step % update_interval == 0:
            rate = target.refresh(C, lambda Cs, X: soft_assign(X, Cs)[2])[0]
            if rate is not None:
                if metrics is not None:
                    metrics.append(("change_rate", step, rate))
                if rate < tol:
                    break
        g, loss, _ = distributed_gradient(target.rows, x_col, (C, None, n), _dec_batch, id_col, ["p"])
        stepv, adam = _adam(adam, g.reshape(C.shape), lr)
        C = C - stepv
        if metrics is not None:
            metrics.append(("bce_loss", step, loss))
    target.drop()
    return C


def _idec_batch(state, X, ids, extra):
    """gamma·BCE(q(h), p) + MSE(x̂, x) over network and centres; p is the row's stored target."""
    net, C, n_total, gamma, use_ae = state
    return _idec_rows(net, C, n_total, gamma, use_ae, X, np.vstack(extra["p"].to_numpy()))


def _idec_rows(net, C, n_total, gamma, use_ae, X, p):
    K, D = C.shape[0], X.shape[1]
    ea = _forward(net["enc"], X)
    H = ea[-1]
    u, s, q = soft_assign(H, C)
    qc = np.clip(q, 1e-12, 1 - 1e-12)
    bce = float(-(p * np.log(qc) + (1 - p) * np.log(1 - qc)).sum()) / (n_total * K)
    g = gamma * (q - p) / (qc * (1 - qc)) / (n_total * K)
    coef = (g - (g * q).sum(1, keepdims=True)) / s * 2.0 * u * u
    gC = coef.T @ H - coef.sum(0)[:, None] * C
    dH = -(coef.sum(1)[:, None] * H - coef @ C)                          # ∂/∂h of the BCE term
    loss = gamma * bce
    gdec_flat = []
    if use_ae:
        da = _forward(net["dec"], H)
        diff = da[-1] - X
        loss += float((diff ** 2).sum()) / (n_total * D)
        gdec, dh2 = _backward(net["dec"], da, 2.0 * diff / (n_total * D))
        dH = dH + dh2
        gdec_flat = [a for (gw, gb) in gdec for a in (gw, gb)]
    else:
        gdec_flat = [np.zeros_like(a) for (W, b) in net["dec"] for a in (W, b)]
    genc, _ = _backward(net["enc"], ea, dH)
    flat = _flatten([a for (gw, gb) in genc for a in (gw, gb)] + gdec_flat + [gC])
    return flat, loss


def _idec_runs_batch(state, X, ids, extra):
    """Gradient and loss of each run, one after another, on the same rows; a run has its place in the stored targets."""
    runs, n_total, gamma, use_ae = state
    P, out = np.vstack(extra["p"].to_numpy()), []
    for at, net, C in runs:
        out += _idec_rows(net, C, n_total, gamma, use_ae, X, P[:, at * len(C):(at + 1) * len(C)])
    return _flatten([np.atleast_1d(a) for a in out]), 0.0


def idec_runs(df: DataFrame, net, centers: list, max_steps: int = 20, update_interval: int = 5, tol: float = 1e-3, lr: float = 1e-3,
              gamma: float = 0.1, use_ae: bool = True, x_col: str = "x", id_col: str = "id", metrics=None):
    """ML-15 from the same network and several starts in the same passes: (net, centres) of each.  A run that a refresh
    ends takes no more steps.  ``metrics`` gets (run, metric, step, value)."""
    n = df.count()
    size = sum(p.size for p in _params(net))
    state = [(dict(net), np.asarray(c, dtype=np.float64).copy()) for c in centers]
    adam = [(np.zeros(size + C.size), np.zeros(size + C.size), 0) for _, C in state]
    target, going, before = FrozenTargets(df, x_col, id_col), list(range(len(state))), None
    place = {}
    for step in range(max_steps if n else 0):
        if step % update_interval == 0:
            rates = target.refresh([state[r] for r in going], lambda s, X: np.hstack([soft_assign(encode_matrix(nt, X), C)[2] for nt, C in s]),
                                   len(going), before and [before[r] for r in going])
            place = before = {r: at for at, r in enumerate(going)}
            if metrics is not None:
                metrics += [(r, "change_rate", step, rate) for r, rate in zip(going, rates) if rate is not None]
            going = [r for r, rate in zip(going, rates) if rate is None or rate >= tol]
            if not going:
                break
        g, _, _ = distributed_gradient(target.rows, x_col, ([(place[r], *state[r]) for r in going], n, gamma, use_ae), _idec_runs_batch, id_col, ["p"])
        at = 0
        for r in going:
            nt, C = state[r]
            own, loss = g[at:at + size + C.size], float(g[at + size + C.size])
            at += size + C.size + 1
            stepv, adam[r] = _adam(adam[r], own, lr)
            state[r] = (_apply_update(dict(nt), stepv[:size]), C - stepv[size:].reshape(C.shape))
            if metrics is not None:
                metrics.append((r, "loss", step, loss))
    target.drop()
    return state


def idec_fit(df: DataFrame, net, centers, max_steps: int = 20, update_interval: int = 5, tol: float = 1e-3,
             lr: float = 1e-3, gamma: float = 0.1, use_ae: bool = True, x_col: str = "x", id_col: str = "id", metrics=None):
    """ML-15: joint training of encoder, decoder (use_ae) and centres with Adam; use_ae=False is DEC.
    p is frozen between refreshes; the share of predictions that a refresh changes is reported, and
    below ``tol`` it ends the training."""
    seen = None if metrics is None else []
    out = idec_runs(df, net, [centers], max_steps, update_interval, tol, lr, gamma, use_ae, x_col, id_col, seen)[0]
    if metrics is not None:
        metrics += [m[1:] for m in seen]
    return out


def clustering_loss_values(df: DataFrame, net, centers, x_col: str = "x", id_col: str = "id") -> DataFrame:
    """EVAL-13: reconstruction MSE, cluster MSE (hidden vs. nearest centre) and BCE(q, p) for fixed
    weights and centres, as one row."""
    C = np.asarray(centers, dtype=np.float64)

    def per_row(state, X):
        nt, Cs = state
        H = encode_matrix(nt, X)
        R = _forward(nt["dec"], H)[-1]
        d2 = (H * H).sum(1)[:, None] - 2 * H @ Cs.T + (Cs * Cs).sum(1)[None, :]
        j = d2.argmin(1)
        return np.column_stack([((R - X) ** 2).mean(1), ((H - Cs[j]) ** 2).mean(1)])

    m = map_rows(df, x_col, (net, C), per_row, "m", [id_col])
    base = m.agg(F.avg(F.col("m")[0]).alias("recons_mse"), F.avg(F.col("m")[1]).alias("cluster_mse"))
    h = autoencoder_encode(df, net, x_col, "h", [id_col])
    q = map_rows(h, "h", C, lambda Cs, H: soft_assign(H, Cs)[2], "q", [id_col]).persist()
    mass = np.array(soft_cluster_mass(q, "q"))
    bce = map_rows(q, "q", mass, lambda ms, Q: (lambda P, Qc: -(P * np.log(Qc) + (1 - P) * np.log(1 - Qc)).mean(1, keepdims=True))(
        target_from_q(Q, ms), np.clip(Q, 1e-12, 1 - 1e-12)), "b", [id_col]).agg(F.avg(F.col("b")[0]).alias("bce"))
    return base.withColumn("_k", F.lit(0)).join(bce.withColumn("_k", F.lit(0)), "_k").drop("_k")


def constraint_loss(pairs: DataFrame, centers, x1: str = "x1", x2: str = "x2") -> DataFrame:
    """ML-21 loss value: mean over pairs and clusters of BCE(q(x1), q(x2)) with q(x2) as the target
    (stop-gradient side), both soft assignments row-local against literal centres."""
    from ..functions.vectors import student_t_assignment
    from .common import literal_matrix
    cs = literal_matrix(centers)
    q = pairs.select(student_t_assignment(x1, cs).alias("q1"), student_t_assignment(x2, cs).alias("q2"))
    b = F.zip_with("q1", "q2", lambda a, t: -(t * F.log(a) + (1 - t) * F.log(1 - a)))
    return q.select(F.explode(b).alias("b")).agg(F.avg("b").alias("constraint_bce"))


# ---------------------------------------------------------------------- pseudo labels (ML-23)

def _pseudo_batch(state, X, ids, extra):
    """gamma·CE(softmax(head(h)), pseudo label) + MSE(x̂, x)."""
    net, head, n_total, gamma = state
    y = extra["target"].to_numpy().astype(int)
    ea = _forward(net["enc"], X)
    H = ea[-1]
    W, b = head
    z = H @ W.T + b
    z = z - z.max(1, keepdims=True)
    P = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    ce = float(-np.log(np.clip(P[np.arange(len(y)), y], 1e-12, None)).sum()) / n_total
    dz = P.copy()
    dz[np.arange(len(y)), y] -= 1.0
    dz *= gamma / n_total
    gW, gb = dz.T @ H, dz.sum(0)
    dH = dz @ W
    da = _forward(net["dec"], H)
    diff = da[-1] - X
    D = X.shape[1]
    gdec, dh2 = _backward(net["dec"], da, 2.0 * diff / (n_total * D))
    genc, _ = _backward(net["enc"], ea, dH + dh2)
    loss = gamma * ce + float((diff ** 2).sum()) / (n_total * D)
    return _flatten([a for (gw, gb2) in genc for a in (gw, gb2)] + [a for (gw, gb2) in gdec for a in (gw, gb2)] + [gW, gb]), loss


def pseudo_label_finetune(df: DataFrame, net, k: int, epochs: int = 3, lr: float = 1e-3, gamma: float = 0.1,
                          x_col: str = "x", id_col: str = "id", seed: int = 0):
    """ML-23: k-means on the hidden vectors gives pseudo labels; the encoder, decoder and a softmax
    head are trained jointly (Adam); returns (net, head, accuracy on the pseudo labels)."""
    from .kmeans_runs import assign_runs, kmeans_runs
    H = autoencoder_encode(df, net, x_col, "h", [id_col]).persist()
    Cs, inertia, _ = kmeans_runs(H, k, 4, id_col, "h", seed=seed)
    lab = assign_runs(H, Cs[[int(np.argmin(inertia))]], [0], id_col, "h").select(id_col, F.col("pred").alias("target"))
    data = df.select(id_col, x_col).join(lab, id_col).persist()
    n = data.count()
    hdim = net["enc"][-1][0].shape[0]
    rng = np.random.default_rng(seed)
    head = (rng.uniform(-1 / np.sqrt(hdim), 1 / np.sqrt(hdim), (k, hdim)), np.zeros(k))
    size = sum(p.size for p in _params(net)) + head[0].size + head[1].size
    adam = (np.zeros(size), np.zeros(size), 0)
    for _ in range(epochs):
        g, loss, _ = distributed_gradient(data, x_col, (net, head, n, gamma), _pseudo_batch, id_col, ["target"])
        step, adam = _adam(adam, g, lr)
        npar = sum(p.size for p in _params(net))
        net = _apply_update(net, step[:npar])
        hw = head[0].size
        head = (head[0] - step[npar:npar + hw].reshape(head[0].shape), head[1] - step[npar + hw:])

    def predict(state, X):
        nt, hd = state
        z = encode_matrix(nt, X) @ hd[0].T + hd[1]
        return np.eye(hd[0].shape[0])[z.argmax(1)]
    p = map_rows(data, x_col, (net, head), predict, "p", [id_col, "target"])
    from ..functions.vectors import argmax
    acc = p.select(F.avg(F.when(argmax("p") == F.col("target"), 1.0).otherwise(0.0))).first()[0]
    data.unpersist()
    return net, head, acc

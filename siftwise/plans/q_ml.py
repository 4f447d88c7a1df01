"""Queries using MLlib, Arrow UDFs and multi-step jobs (rows-only checks)."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.sql import functions as F

from ..config import EVAL_MIN_DF, NB_ALPHAS, QUERY_BATCH_FORUM, RANDOM_SEED, SEED_SIZE
from ..functions import text as X
from ..functions.normalise import normalise_unicode
from ..operators import active as A
from ..operators import blocks as BL
from ..operators import boosting as G
from ..operators import classify as C
from ..operators import linear as L
from ..operators import lsa as E
from ..operators import models as ML
from ..operators import naive_bayes as NB
from ..operators import sampling as Q
from ..operators import tfidf as T
from ..operators import versions as VS
from ..operators import votes as V
from ..sources.tables import table
from . import sql as S
from .cache import memo
from .fixtures import DAMAGED
from .q_labels import UNANIMOUS_MODELS
from .q_models import NB_ALPHA, POOL_CTE, holdout_column, pool_features, stop_table
from .q_text import CAND_SQL, clean_articles, seed_candidate_table
from .q_votes import fixture_first_votes
from .registry import query

LEARNING_CURVE_SIZES = [200, 250, 300, 350, 400]


def scratch_dir(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    base = spark.conf.get("spark.checkpoint.dir")
    return f"{base.rstrip('/')}/siftwise-{name}-{uuid.uuid4().hex[:12]}"


# ----------------------------------------------------------------- X3-X5
@query("article_normalise")
def article_normalise(spark, sf_dir):
    """Entity decoding, mojibake repair and NFKC on cleaned articles (one Arrow UDF)."""
    a = clean_articles(spark, sf_dir)
    n = normalise_unicode(F.col("text"))
    return a.select("article_id", n.alias("text"), F.length(n).cast("long").alias("n_chars"))


_REPAIRED = "[" + ", ".join(S.q(b) for _, b in DAMAGED) + "]"


@query("text_repair", f"""
SELECT doc_id AS id, md5(text || ' ' || {_REPAIRED}[CAST(doc_id % {len(DAMAGED)} AS INTEGER) + 1]) AS text_md5,
       length(text || ' ' || {_REPAIRED}[CAST(doc_id % {len(DAMAGED)} AS INTEGER) + 1])::BIGINT AS n_chars
FROM documents""")
def text_repair(spark, sf_dir):
    """Documents with damaged passages after them, each passage repaired and nothing else."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    snippet = F.element_at(F.array(*[F.lit(a) for a, _ in DAMAGED]), (F.col("doc_id") % len(DAMAGED) + 1).cast("int"))
    fixed = d.select(F.col("doc_id").alias("id"), normalise_unicode(F.concat("text", F.lit(" "), snippet)).alias("text"))
    return fixed.select("id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


# ----------------------------------------------------------------- L2-L4 L6 L9 M8 U2
def labelled_rows(features, labelled):
    """Rows of a comparison: (id, label, fold, pos, features) of the labelled items that have features."""
    return features.join(labelled.select("id", "label", "fold", "pos"), "id").select("id", "label", "fold", "pos", "features")


def with_folds(train, test):
    """Folds of the training items; fold and pos of test items, and pos here, are not used."""
    tr = ML.fold_column(train.select("id", "label")).withColumn("pos", F.lit(0)).checkpoint()
    return tr, test.select("id", "label", F.lit(0).alias("fold"), F.lit(0).alias("pos"))


def embedding_branch(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("features"), (F.col("label") < 5).cast("int").alias("label"))
    split = holdout_column(e.select("id", "label"), 0.25)
    tr, te = with_folds(split.where(F.col("split") == "train"), split.where(F.col("split") == "test"))
    features = e.select("id", "features")
    width = features.select(F.size("features")).first()[0]
    return ML.Branch("embeddings", "gold", labelled_rows(features, tr), labelled_rows(features, te), width, False, ML.DENSE_MODELS)


def llm_label_sets(spark, sf_dir):
    """(train, test) as (id, label, text, lang): unanimous annotator labels minus
    gold items for training, the gold items for testing."""
    agreed = V.unanimous(fixture_first_votes(spark, sf_dir).where(F.col("model").isin(UNANIMOUS_MODELS)),
                         UNANIMOUS_MODELS)
    gold = table(spark, sf_dir, "labels", "doc_id", "quality").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    docs = text_items(spark, sf_dir)
    return agreed.join(gold.select("id"), "id", "left_anti").join(docs, "id"), gold.join(docs, "id")


def text_items(spark, sf_dir):
    return (table(spark, sf_dir, "documents", "doc_id", "text", "lang").withColumnRenamed("doc_id", "id")
            .where(X.has_text("text")))


def human_label_sets(spark, sf_dir):
    """(train, test) as (id, label, text, lang): active-learning labels minus gold items for
    training, the gold items for testing (gold: two thirds of the labels here)."""
    lab = table(spark, sf_dir, "labels", "doc_id", "quality").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    gold = lab.where(F.col("id") % 3 != 1)
    docs = text_items(spark, sf_dir)
    labelled = lab.where(F.col("id") % 3 != 0).join(gold.select("id"), "id", "left_anti")
    return labelled.join(docs, "id"), gold.join(docs, "id")


def tfidf_branch(source, train, test, tr, te, limit=None):
    """(1,2)-gram sublinear TF-IDF fitted on the training texts only, as sparse features.

    With ``limit`` only rows before it in label order are wanted (the vocabulary is still of all
    training texts).  Terms that none of their training texts has are one last feature then, so
    the features are no more than those texts hold."""
    parts = T.partitions_for(train)
    train_terms = T.doc_terms(train, ngrams=(1, 2), partitions=parts).persist(StorageLevel.MEMORY_AND_DISK)
    vocab = T.fit_vocabulary(train_terms, train.select(F.count("*")).scalar(), min_df=EVAL_MIN_DF, partitions=parts).checkpoint()
    if limit is not None:
        tr, te = (lab.where(F.col("pos") < limit) for lab in (tr, te))
        seen, tried = (docs.join(lab.select("id"), "id", "left_semi") for docs, lab in ((train, tr), (test, te)))
        weights = [T.transform(terms, vocab, sublinear=True).checkpoint() for terms in (
            train_terms.join(tr.select("id"), "id", "left_semi"), T.doc_terms(tried, ngrams=(1, 2)))]
        index = T.vocabulary_index(weights[0].select("term").distinct()).checkpoint()
        own = index.count()
        rows = [labelled_rows(T.sparse_features(w, index, docs, own), lab).checkpoint() for w, docs, lab in zip(weights, (seen, tried), (tr, te))]
        train_terms.unpersist()
        return ML.Branch("tfidf", source, *rows, own + 1, True, ML.TEXT_MODELS, vocab.count() - own)
    index = T.vocabulary_index(vocab)
    rows = [labelled_rows(T.sparse_features(T.transform(terms, vocab, sublinear=True, partitions=parts), index, docs), lab).checkpoint()
            for terms, docs, lab in ((train_terms, train, tr), (T.doc_terms(test, ngrams=(1, 2), partitions=parts), test, te))]
    train_terms.unpersist()
    return ML.Branch("tfidf", source, *rows, max(1, vocab.count()), True, ML.TEXT_MODELS)


def hashed_branch(source, train, test, tr, te):
    """Hashed-text features, encoded once; items whose encoding fails are left out."""
    rows = [labelled_rows(C.encode(d.select("id", "text")).where(F.col("error").isNull()).select("id", F.col("embedding").alias("features")), lab).checkpoint()
            for d, lab in ((train, tr), (test, te))]
    return ML.Branch("hashed-text", source, *rows, C.EMBED_DIM, False, ML.DENSE_MODELS)


def text_vectors(spark, sf_dir):
    """V3: the second encoder, fitted on the pool: (vocabulary, term vectors, their length)."""
    def build():
        _, vocab, w = pool_features(spark, sf_dir, persist=True, reuse_weights=True)
        vectors, values = E.fit(w, vocab)
        return vocab, vectors, len(values)
    return memo(spark, ("text_vectors", sf_dir), build)


def vectors_branch(spark, sf_dir, source, train, test, tr, te):
    """Texts as unit vectors in the space of the pool's leading singular vectors."""
    vocab, vectors, width = text_vectors(spark, sf_dir)
    def features(docs):
        w = T.transform(T.doc_terms(docs, stop_words=stop_table(spark)), vocab, broadcast_vocab=True)
        return E.encode(docs, w, vectors, width)
    rows = [labelled_rows(features(d), lab).checkpoint() for d, lab in ((train, tr), (test, te))]
    return ML.Branch("text-vectors", source, *rows, width, False, ML.DENSE_MODELS)


def text_branches(spark, sf_dir, source, train, test, tr, te, limit=None):
    """Builders of the three text branches over one pair of sets."""
    train, test = train.checkpoint(), test.checkpoint()
    return [lambda: tfidf_branch(source, train, test, tr, te, limit), lambda: hashed_branch(source, train, test, tr, te),
            lambda: vectors_branch(spark, sf_dir, source, train, test, tr, te)]


def built(jobs):
    """Branches from independent builders, submitted together."""
    with ThreadPoolExecutor(max_workers=len(jobs)) as pool:
        return [f.result() for f in [pool.submit(fn) for fn in jobs]]


def cv_table(spark, sf_dir):
    """Six text branches (three encoders by two label sources) and the embeddings table, whose
    labels are its own; all models of all branches are fitted together."""
    def build():
        text_vectors(spark, sf_dir)
        jobs = [lambda: embedding_branch(spark, sf_dir)]
        for source, sets in (("annotators", llm_label_sets), ("human", human_label_sets)):
            train, test = sets(spark, sf_dir)
            jobs += text_branches(spark, sf_dir, source, train, test, *with_folds(train, test))
        return ML.result_table(spark, ML.compare(built(jobs))).drop("n_labels").checkpoint()
    return memo(spark, ("cv", sf_dir), build)


@query("cv_results")
def cv_results(spark, sf_dir):
    """Grid-searched, cross-validated models per feature branch and label source."""
    return cv_table(spark, sf_dir).orderBy("branch", "label_source", F.col("cv_f1").desc(), "place").drop("place")


@query("best_model")
def best_model(spark, sf_dir):
    """M9: the best configuration overall by Cohen's kappa (earlier rows win ties)."""
    return ML.best_overall(cv_table(spark, sf_dir))


# ----------------------------------------------------------------- L11 L12
def curve_sets(spark, sf_dir):
    """All labelled texts with their position in label order (by id), split 75/25."""
    lab = table(spark, sf_dir, "labels", "doc_id", "quality").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    items = lab.join(text_items(spark, sf_dir), "id")
    pos = Q.with_position(items.select("id", "label"), ["id"])
    split = holdout_column(pos.select("id", "label"), 0.25).select("id", "split")
    labelled = pos.join(split, "id").checkpoint()
    tr = ML.fold_column(labelled.where(F.col("split") == "train").select("id", "label")).join(labelled.select("id", "pos"), "id").checkpoint()
    te = labelled.where(F.col("split") == "test").select("id", "label", F.lit(0).alias("fold"), "pos")
    keep = lambda part: items.join(part.select("id"), "id", "left_semi")
    return keep(tr), keep(te), tr, te


@query("learning_curve")
def learning_curve(spark, sf_dir):
    """All models and text branches on the first 200 to 400 labels (what is trained and tested
    on with n labels is part of what is with more).  Vectorisers are fitted once, on all training texts."""
    train, test, tr, te = curve_sets(spark, sf_dir)
    rows = ML.compare(built(text_branches(spark, sf_dir, "human", train, test, tr, te, max(LEARNING_CURVE_SIZES))), tuple(LEARNING_CURVE_SIZES))
    trained = tr.select(*[F.sum((F.col("pos") < k).cast("long")).alias(str(k)) for k in LEARNING_CURVE_SIZES]).first()
    n = spark.createDataFrame([(k, trained[str(k)]) for k in LEARNING_CURVE_SIZES], "n_labels int, n_train long")
    return ML.result_table(spark, rows).join(F.broadcast(n), "n_labels").drop("label_source", "place")


_CURVE_SQL = f"""
WITH lab AS (SELECT l.doc_id AS id, l.quality AS label, d.text, row_number() OVER (ORDER BY l.doc_id) - 1 AS pos,
                    row_number() OVER (ORDER BY md5('{RANDOM_SEED}:' || l.doc_id::VARCHAR), l.doc_id) - 1 < ceil(count(*) OVER () * 0.25) AS is_test
             FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE d.text IS NOT NULL AND d.text <> ''),
toks AS (SELECT id, label, pos, is_test, {S.tokens('text')} AS t FROM lab),
grams AS (SELECT id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM toks),
terms AS (SELECT id, term, count(*) AS cnt FROM grams GROUP BY ALL),
n AS (SELECT count(*) AS n FROM lab WHERE NOT is_test),
vocab AS (SELECT term, ln((1 + any_value(n.n)) / (1 + count(*))) + 1 AS idf FROM terms JOIN lab USING (id), n WHERE NOT is_test
          GROUP BY term HAVING count(*) >= {EVAL_MIN_DF}),
w0 AS (SELECT id, term, (1 + ln(cnt)) * idf AS w FROM terms JOIN vocab USING (term)),
weights AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM w0),
sizes AS (SELECT unnest([{', '.join(map(str, LEARNING_CURVE_SIZES))}]) AS n_labels),
alphas AS (SELECT unnest([{', '.join(map(str, NB_ALPHAS))}]::DOUBLE[]) AS alpha),
sums AS (SELECT n_labels, term, sum(weight) FILTER (WHERE label = 0) AS s0, sum(weight) FILTER (WHERE label = 1) AS s1
         FROM sizes JOIN lab ON pos < n_labels AND NOT is_test JOIN weights USING (id) GROUP BY ALL),
smooth AS (SELECT n_labels, alpha, term, coalesce(s0, 0) + alpha AS a0, coalesce(s1, 0) + alpha AS a1
           FROM sizes CROSS JOIN alphas CROSS JOIN vocab LEFT JOIN sums USING (n_labels, term)),
model AS (SELECT n_labels, alpha, term, ln(a1 / sum(a1) OVER g) - ln(a0 / sum(a0) OVER g) AS ratio FROM smooth WINDOW g AS (PARTITION BY n_labels, alpha)),
prior AS (SELECT n_labels, ln(count(*) FILTER (WHERE label = 1) / count(*) FILTER (WHERE label = 0)) AS p FROM sizes JOIN lab ON pos < n_labels AND NOT is_test GROUP BY n_labels),
odds AS (SELECT lab.id, label, prior.n_labels, alphas.alpha, any_value(p) + coalesce(sum(weight * ratio), 0) AS o
         FROM prior JOIN lab ON pos < n_labels AND is_test CROSS JOIN alphas LEFT JOIN weights USING (id)
         LEFT JOIN model ON model.n_labels = prior.n_labels AND model.alpha = alphas.alpha AND model.term = weights.term GROUP BY lab.id, label, prior.n_labels, alphas.alpha)
SELECT n_labels, alpha, count(*) FILTER (WHERE label = 0 AND NOT o > 0) AS tn, count(*) FILTER (WHERE label = 0 AND o > 0) AS fp,
       count(*) FILTER (WHERE label = 1 AND NOT o > 0) AS fn, count(*) FILTER (WHERE label = 1 AND o > 0) AS tp
FROM odds GROUP BY n_labels, alpha"""


@query("learning_curve_bayes", _CURVE_SQL)
def learning_curve_bayes(spark, sf_dir):
    """The naive Bayes models of the curve, every size by every smoothing, on the test texts."""
    train, test, tr, te = curve_sets(spark, sf_dir)
    b = tfidf_branch("human", train, test, tr, te, max(LEARNING_CURVE_SIZES))
    columns = [L.Column(b.key, L.BAYES, a, BL.Part(-1, n)) for n in LEARNING_CURVE_SIZES for a in NB_ALPHAS]
    weights = L.fit(BL.pack(b.train, b.key, b.width, True), columns, {b.key: b.width}, last={b.key: b.last})
    got = L.counts(BL.pack(b.test, b.key, b.width, True), columns, weights, False)
    return spark.createDataFrame([(c.part.limit, c.value, *got.get(k, (0, 0, 0, 0))) for k, c in enumerate(columns)],
                                 "n_labels int, alpha double, tn long, fp long, fn long, tp long")


# ----------------------------------------------------------------- V3-V5 L10 K3 K8 J7
def trained_text_model(spark, sf_dir):
    """L10 training: encoded unanimous-label texts (gold excluded) -> class-weighted
    boosted trees.  Trained once per application and shared by the batch
    and streaming classification queries."""
    def build():
        train, _ = llm_label_sets(spark, sf_dir)
        enc = C.encode(train.select("id", "label", "text")).where(F.col("error").isNull())
        model = G.fit_one(enc.select("id", "label", F.col("embedding").alias("features")).checkpoint(), ML.BULK, C.EMBED_DIM)
        model.features = "embedding"
        return model
    return memo(spark, ("text_model", sf_dir), build)


def routed_documents(spark, sf_dir, model=None):
    model = model or trained_text_model(spark, sf_dir)
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumnRenamed("doc_id", "id") \
        .where(X.has_text("text"))
    return C.classify(model, C.encode(docs.select("id", "text")))


@query("bulk_classify")
def bulk_classify(spark, sf_dir):
    """Train on unanimous annotator labels, encode every document once, route it;
    (id, text) go to one folder per route in a single write."""
    base = scratch_dir(spark, "routes")
    C.write_routes(routed_documents(spark, sf_dir), base)
    return spark.read.parquet(base).select("id", "route")


@query("bulk_classify_quarantine")
def bulk_classify_quarantine(spark, sf_dir):
    """V4/K8: items whose encoding failed, kept (not dropped) with the route totals."""
    routed = routed_documents(spark, sf_dir)
    return C.route_counts(routed)


# ----------------------------------------------------------------- Q4 Q5 Q6
AL_STOP_AFTER = 10


def _nb_round_sql(k: int) -> str:
    """Model of the labels ``known{k}`` and the queue of the least confident rest."""
    conf = "greatest(1.0 / (1.0 + exp(-lo)), 1 - 1.0 / (1.0 + exp(-lo)))"
    return f"""
fc{k} AS (SELECT term, sum(weight) FILTER (WHERE label = 0) AS f0, sum(weight) FILTER (WHERE label = 1) AS f1
          FROM weights JOIN known{k} USING (id) GROUP BY term),
sm{k} AS (SELECT term, coalesce(f0, 0) + {NB_ALPHA} AS a0, coalesce(f1, 0) + {NB_ALPHA} AS a1 FROM vocab LEFT JOIN fc{k} USING (term)),
df{k} AS (SELECT term, ln(a1 / sum(a1) OVER ()) - ln(a0 / sum(a0) OVER ()) AS d FROM sm{k}),
pr{k} AS (SELECT coalesce(ln(nullif(count(*) FILTER (WHERE label = 1), 0) / count(*)), 0)
               - coalesce(ln(nullif(count(*) FILTER (WHERE label = 0), 0) / count(*)), 0) AS p FROM known{k}),
lo{k} AS (SELECT pool.id, any_value(p) + coalesce(sum(weight * d), 0) AS lo FROM pool CROSS JOIN pr{k} LEFT JOIN weights ON weights.id = pool.id
          LEFT JOIN df{k} ON df{k}.term = weights.term WHERE pool.id NOT IN (SELECT id FROM known{k}) GROUP BY pool.id),
queue{k} AS (SELECT id, row_number() OVER (ORDER BY {S.rfix(conf, 8)}, id) AS rank
             FROM (SELECT * FROM lo{k} ORDER BY {S.rfix('abs(lo)', 8)}, id LIMIT {QUERY_BATCH_FORUM}))"""


_AL_SQL = CAND_SQL + f""", {POOL_CTE.replace('toks', 'pool_toks')},
answers AS (SELECT id, coalesce(quality, id % 2)::INTEGER AS label FROM pool LEFT JOIN labels ON doc_id = id),
able AS (SELECT id FROM cand WHERE id IN (SELECT id FROM pool)),
drawn AS (SELECT id FROM able WHERE (SELECT count(*) FROM able) >= {SEED_SIZE} UNION ALL SELECT id FROM pool WHERE (SELECT count(*) FROM able) < {SEED_SIZE}),
seed AS (SELECT id FROM drawn ORDER BY md5('{RANDOM_SEED}:' || id::VARCHAR), id LIMIT {SEED_SIZE}),
known2 AS (SELECT id, label, 1 AS round FROM seed JOIN answers USING (id)),
{_nb_round_sql(2)},
known3 AS (SELECT id, label, round FROM known2 UNION ALL SELECT id, label, 2 FROM queue2 JOIN answers USING (id)),
{_nb_round_sql(3)}
SELECT round, id, label, 'labelled' AS status FROM known3
UNION ALL SELECT 3, id, CASE WHEN rank <= {AL_STOP_AFTER} THEN label END, CASE WHEN rank <= {AL_STOP_AFTER} THEN 'labelled' ELSE 'queued' END
FROM queue3 JOIN answers USING (id)"""


@query("al_round", _AL_SQL)
def al_round(spark, sf_dir):
    """Q4: active learning over saved labels.  Round 1: the keyword seed.  Round 2: resume
    (an unknown id in the saved labels is skipped), naive Bayes, the 25 least confident,
    all answered.  Round 3: resume, next queue, the labeller stops after ten: those are
    saved and the model is left as it was.

    Each round commits a version of the labels, and of the model's counts only what its own
    labels change; the next round reads those versions."""
    docs, vocab, w = pool_features(spark, sf_dir, persist=True, reuse_weights=True)
    pool = docs.select("id")
    answers = (pool.join(table(spark, sf_dir, "labels", "doc_id", "quality").withColumnRenamed("doc_id", "id"), "id", "left")
               .select("id", F.coalesce("quality", (F.col("id") % 2).cast("int")).alias("label")))
    base, counts = scratch_dir(spark, "al"), scratch_dir(spark, "al-counts")

    def save(labels, rnd):
        """K7: the labels as they are now, in place of those before."""
        version = VS.write(labels, base, f"round-{rnd}", VS.REPLACE)
        return VS.read(spark, base, labels.schema, version).drop("run")

    candidates = seed_candidate_table(spark, sf_dir).join(pool, "id", "left_semi")
    _, seed = A.start(pool, candidates, None, SEED_SIZE)
    unknown = spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit(1).alias("label"), F.lit(1).alias("round"), F.lit(1).alias("seq"))
    saved = save(A.record(None, seed, answers, 1).unionByName(unknown), 1)
    before = spark.createDataFrame([], "id long, label int")
    for rnd in (2, 3):
        labelled, _ = A.start(pool, candidates, saved, SEED_SIZE)
        labelled = labelled.checkpoint()
        VS.write(NB.count_changes(w, before, labelled), counts, f"round-{rnd}")
        model, priors = NB.from_counts(VS.read(spark, counts, NB.COUNTS), vocab, NB_ALPHA)
        rest = pool.join(labelled, "id", "left_anti")
        queue = A.ranked(NB.least_confident(NB.log_odds(w, rest, model, priors), QUERY_BATCH_FORUM)).checkpoint()
        saved, before = save(A.record(saved, queue, answers, rnd, AL_STOP_AFTER if rnd == 3 else None), rnd), labelled
    labelled, _ = A.start(pool, candidates, saved, SEED_SIZE)
    left = queue.join(labelled.select("id"), "id", "left_anti")
    return labelled.select("round", "id", "label", F.lit("labelled").alias("status")).unionByName(
        left.select(F.lit(3).alias("round"), "id", F.lit(None).cast("int").alias("label"), F.lit("queued").alias("status")))

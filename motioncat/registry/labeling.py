"""Labels, persons, training pairs, profiles and auto-labelling."""

from __future__ import annotations

from pyspark.sql import functions as F

from motioncat import fixtures as fx
from motioncat.fixtures import with_ctes
from motioncat.functions.boxes import crop_name
from motioncat.operators import crops
from motioncat.operators import labels as lb
from motioncat.registry import query
from motioncat.registry.common import rounded
from motioncat.session import scratch_path
from motioncat.sources import labels as files

# clusters are the given vectors; every fifth gets a second label event, every seventh leaves its person
EVENTS = """SELECT vec_id AS cluster_id, seq, CASE WHEN seq = 0 THEN concat('P', label) ELSE concat('P', label, '-fixed') END AS label,
  CASE WHEN seq = 1 THEN 'again' END AS notes, CASE WHEN vec_id % 3 = 0 THEN false WHEN vec_id % 3 = 1 THEN true END AS verified
  FROM ({src}) WHERE seq = 0 OR vec_id % 5 = 0"""
MEGA_EVENTS = """SELECT vec_id AS cluster_id, seq, CASE WHEN seq = 0 THEN 'create' WHEN vec_id % 7 = 0 THEN 'remove' ELSE 'add' END AS action,
  CASE WHEN seq = 0 THEN label * 100 + vec_id % 40 ELSE label * 100 + vec_id % 3 END AS mega_id FROM ({src}) WHERE seq = 0 OR vec_id % 7 = 0 OR vec_id % 4 = 1"""
DUCK_SRC = "SELECT e.vec_id, e.label, s.seq FROM embeddings e CROSS JOIN (SELECT unnest([0, 1]) AS seq) s"
LE, ME = EVENTS.format(src=DUCK_SRC), MEGA_EVENTS.format(src=DUCK_SRC)


def _from_vectors(spark, sf, sql):
    fx.table(spark, sf, "embeddings").createOrReplaceTempView("_vectors")
    return spark.sql(sql.format(src="SELECT vec_id, label, explode(array(0, 1)) AS seq FROM _vectors"))


def label_events(spark, sf):
    return _from_vectors(spark, sf, EVENTS)


def mega_events(spark, sf):
    return _from_vectors(spark, sf, MEGA_EVENTS)


def clusters(spark, sf):
    return fx.people(spark, sf).groupBy(F.col("vec_id").alias("cluster_id")).agg(F.count("*").alias("cluster_size"))


LAB = f"""le AS ({LE}), me AS ({ME}), lab AS (SELECT cluster_id, label, notes, coalesce(verified, true) AS verified FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY seq DESC) AS rn FROM le) WHERE rn = 1),
  meg AS (SELECT cluster_id, mega_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY seq DESC) AS rn FROM me) WHERE rn = 1 AND action <> 'remove'),
  cl AS (SELECT vec_id AS cluster_id, count(*) AS cluster_size FROM people GROUP BY 1)"""


@query("assign_labels", with_ctes("people", f"WITH {LAB} SELECT * FROM lab"))
def assign_labels(spark, sf):
    return lb.assign_labels(label_events(spark, sf))


@query("mega_membership", with_ctes("people", f"WITH {LAB} SELECT * FROM meg"))
def mega_membership(spark, sf):
    return lb.mega_membership(mega_events(spark, sf))


@query("mega_survivors", with_ctes("people", f"""WITH {LAB}, mv AS (SELECT *, lag(CASE WHEN action <> 'remove' THEN mega_id END) OVER (PARTITION BY cluster_id ORDER BY seq) AS old FROM me),
  lv AS (SELECT old AS mega_id, arg_max(action, seq * 1000000 + cluster_id) AS last_leave FROM mv WHERE old IS NOT NULL GROUP BY old),
  made AS (SELECT DISTINCT mega_id FROM me WHERE action <> 'remove'), n AS (SELECT mega_id, count(*) AS members FROM meg GROUP BY 1)
  SELECT made.mega_id, coalesce(members, 0) AS members FROM made LEFT JOIN n USING (mega_id) LEFT JOIN lv USING (mega_id) WHERE members IS NOT NULL OR last_leave = 'add'"""))
def mega_survivors(spark, sf):
    """Event order over the table: the round, then the cluster."""
    ordered = mega_events(spark, sf).withColumn("seq", F.col("seq") * 1000000 + F.col("cluster_id"))
    return lb.surviving_megas(ordered)


@query("clusters_with_labels", with_ctes("people", f"WITH {LAB} SELECT cl.*, label, notes, verified, mega_id FROM cl LEFT JOIN lab USING (cluster_id) LEFT JOIN meg USING (cluster_id)"))
def clusters_with_labels(spark, sf):
    return lb.clusters_with_labels(clusters(spark, sf), lb.assign_labels(label_events(spark, sf)), lb.mega_membership(mega_events(spark, sf)))


@query("unclustered", with_ctes("people", f"WITH {LAB} SELECT cl.* FROM cl WHERE cluster_id NOT IN (SELECT cluster_id FROM meg)"))
def unclustered(spark, sf):
    return lb.unclustered(clusters(spark, sf), lb.mega_membership(mega_events(spark, sf)))


@query("mega_summary", with_ctes("people", f"""WITH {LAB} SELECT mega_id, count(*) AS clusters, CAST(sum(cluster_size) AS BIGINT) AS embeddings,
  count(*) FILTER (WHERE verified) AS verified, min(cluster_id) AS first_cluster, max(cluster_id) AS last_cluster FROM cl JOIN meg USING (cluster_id) LEFT JOIN lab USING (cluster_id) GROUP BY 1"""))
def mega_summary(spark, sf):
    return lb.mega_summary(clusters(spark, sf), lb.assign_labels(label_events(spark, sf)), lb.mega_membership(mega_events(spark, sf)))


@query("labeling_status", with_ctes("people", f"""WITH {LAB}, j AS (SELECT * FROM cl LEFT JOIN lab USING (cluster_id) LEFT JOIN meg USING (cluster_id)),
  t AS (SELECT count(*) AS clusters, count(label) AS labeled, count(*) FILTER (WHERE verified) AS verified, count(mega_id) AS in_mega FROM j)
  SELECT *, round(labeled * 100 / clusters, 6) AS labeled_pct, round(verified * 100 / clusters, 6) AS verified_pct, round(in_mega * 100 / clusters, 6) AS in_mega_pct FROM t"""))
def labeling_status(spark, sf):
    out = lb.labeling_status(clusters(spark, sf), lb.assign_labels(label_events(spark, sf)), lb.mega_membership(mega_events(spark, sf)))
    return rounded(out, "labeled_pct", "verified_pct", "in_mega_pct")


# ---- training pairs ----
@query("training_pairs_positive", with_ctes("people", """SELECT p.label AS mega_id, p.ord, count(q.ord) AS partners,
    (SELECT count(*) FROM people o WHERE o.label = p.label AND o.ord <= p.ord) AS pos,
    sum(count(q.ord)) OVER (PARTITION BY p.label ORDER BY p.ord) - count(q.ord) AS pair_offset
  FROM people p LEFT JOIN people q ON q.label = p.label AND q.ord > p.ord GROUP BY p.label, p.ord""".replace("sum(count(q.ord)) OVER (PARTITION BY p.label ORDER BY p.ord) - count(q.ord)", "CAST(sum(count(q.ord)) OVER (PARTITION BY p.label ORDER BY p.ord) - count(q.ord) AS BIGINT)")))
def training_pairs_positive(spark, sf):
    """Run-length coded pairs; the check counts the pairs of the full self join."""
    return lb.positive_pairs(fx.people(spark, sf).withColumnRenamed("label", "mega_id"))


@query("training_pairs_negative", with_ctes("people", """WITH h AS (SELECT mega, ord, row_number() OVER (PARTITION BY mega ORDER BY ord) AS r FROM (SELECT vec_id AS mega, ord FROM people)),
  f AS (SELECT * FROM h WHERE r <= 5), n AS (SELECT mega, count(*) AS n FROM h GROUP BY mega), l AS (SELECT CAST(2 * sum(n * (n - 1) // 2) AS BIGINT) AS lim FROM n),
  p AS (SELECT a.mega AS mega1, b.mega AS mega2, a.ord AS ord1, b.ord AS ord2, row_number() OVER (ORDER BY a.mega, b.mega, a.ord, b.ord) AS place FROM f a JOIN f b ON a.mega < b.mega)
  SELECT mega1, mega2, ord1, ord2 FROM p WHERE place <= (SELECT lim FROM l)"""))
def training_pairs_negative(spark, sf):
    return lb.negative_pairs(fx.people(spark, sf).withColumnRenamed("vec_id", "mega_id").select("mega_id", "ord"))


# ---- documents ----
@query("label_documents", with_ctes("people", f"""WITH {LAB} SELECT cluster_id, label, CAST(1 AS DOUBLE) AS confidence, coalesce(notes, '') AS notes, verified, '2024-02-01T00:00:00' AS timestamp FROM lab"""))
def label_documents(spark, sf):
    """Labels written as documents and read back; a label without a note gets an empty one."""
    path = scratch_path(spark, "labels-json")
    files.write_labels_json(lb.assign_labels(label_events(spark, sf)), path, "2024-02-01T00:00:00", clusters(spark, sf).count())
    return files.read_labels_json(spark, path)


@query("mega_documents", with_ctes("people", f"""WITH {LAB} SELECT cluster_id, CAST(mega_id AS VARCHAR) AS mega_id, concat('person ', mega_id) AS person_name FROM meg"""))
def mega_documents(spark, sf):
    path = scratch_path(spark, "megas-json")
    members = lb.mega_membership(mega_events(spark, sf)).withColumn("person_name", F.concat(F.lit("person "), F.col("mega_id")))
    files.write_megas_json(members, path, "2024-02-01T00:00:00", clusters(spark, sf).count())
    megas, back = files.read_megas_json(spark, path)
    return back.join(megas, "mega_id").select("cluster_id", "mega_id", "person_name")


# ---- profiles ----
def persons(spark, sf):
    return fx.people(spark, sf).withColumn("person", F.concat(F.lit("P"), F.col("vec_id").cast("string")))


PROFILE = """pp AS (SELECT concat('P', vec_id) AS person, ord, embedding FROM people), n AS (SELECT person, count(*) AS n FROM pp GROUP BY 1),
  x AS (SELECT p.person, p.ord AS i, q.ord AS j, list_cosine_similarity(p.embedding, q.embedding) AS sim FROM pp p JOIN pp q ON p.person = q.person AND p.ord < q.ord),
  ex AS (SELECT person, sim, (n - 1) * (n - 1) AS w FROM x JOIN n USING (person) UNION ALL SELECT person, 1.0, n * (n - 1) * (n - 2) // 2 FROM n WHERE n > 1),
  m AS (SELECT person, sum(sim * w) / sum(w) AS mean, sum(sim * sim * w) / sum(w) AS sq FROM ex GROUP BY 1),
  th AS (SELECT person, greatest(0.7, mean - 2 * sqrt(greatest(0, sq - mean * mean))) AS threshold FROM m),
  v AS (SELECT person, pos, avg(x) AS a, stddev_pop(x) AS s FROM (SELECT person, unnest(embedding) AS x, unnest(generate_series(1, len(embedding))) AS pos FROM pp) GROUP BY 1, 2),
  pr AS (SELECT person, list(a ORDER BY pos) AS profile, list(s ORDER BY pos) AS std FROM v GROUP BY 1)"""


@query("person_profiles", with_ctes("people", f"""WITH {PROFILE} SELECT person, n * (n - 1) AS samples, round(threshold, 6) AS threshold, round(list_sum(profile), 6) AS mean_total,
  round(profile[7], 6) AS mean_7, round(list_sum(std), 6) AS std_total FROM th JOIN n USING (person) JOIN pr USING (person)"""))
def person_profiles(spark, sf):
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 6)
    return lb.person_profiles(persons(spark, sf)).select(
        "person", "samples", F.round("threshold", 6).alias("threshold"), total("profile").alias("mean_total"),
        F.round(F.get("profile", F.lit(6)), 6).alias("mean_7"), total("std").alias("std_total"),
    )


@query("profile_documents", with_ctes("people", f"""WITH {PROFILE} SELECT person, n * (n - 1) AS samples, round(threshold, 6) AS threshold, round(list_sum(profile), 6) AS mean_total,
  round(list_sum(std), 6) AS std_total, CAST(0.8 AS DOUBLE) AS confidence_threshold FROM th JOIN n USING (person) JOIN pr USING (person)"""))
def profile_documents(spark, sf):
    path = scratch_path(spark, "profiles-json")
    files.write_profiles_json(lb.person_profiles(persons(spark, sf)), path, "2024-02-01T00:00:00")
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 6)
    return files.read_profiles_json(spark, path).select(
        "person", "samples", F.round("threshold", 6).alias("threshold"), total("profile").alias("mean_total"), total("std").alias("std_total"), "confidence_threshold"
    )


NRM = "sqrt(list_dot_product({0}, {0}))"
SIMS = f"""{PROFILE}, sims AS (SELECT p.ord, th.person, threshold, list_dot_product(embedding, profile) / (({NRM.format('embedding')} + 1e-8) * ({NRM.format('profile')} + 1e-8)) AS sim
  FROM people p CROSS JOIN th JOIN pr USING (person))"""


@query("profile_match", with_ctes("people", f"WITH {SIMS} SELECT ord, person, round(sim, 6) AS similarity FROM sims WHERE sim > threshold"))
def profile_match(spark, sf):
    people = persons(spark, sf)
    return rounded(lb.profile_matches(people, lb.person_profiles(people)), "similarity")


AUTO = f"""{SIMS}, t AS (SELECT ord, list(sim ORDER BY sim DESC) AS s, max(CASE WHEN sim > threshold THEN sim END) AS best FROM sims GROUP BY ord),
  b AS (SELECT ord, person FROM (SELECT ord, person, row_number() OVER (PARTITION BY ord ORDER BY sim DESC, person) AS rn FROM sims WHERE sim > threshold AND sim > 0) WHERE rn = 1),
  au AS (SELECT t.ord, b.person, coalesce(best, 0) AS similarity, CASE WHEN len(s) >= 2 THEN least(1, coalesce(best, 0) + s[1] - s[2]) ELSE coalesce(best, 0) END AS confidence FROM t LEFT JOIN b USING (ord))"""


@query("auto_label", with_ctes("people", f"WITH {AUTO} SELECT ord, person, round(similarity, 6) AS similarity, round(confidence, 6) AS confidence FROM au"))
def auto_label(spark, sf):
    people = persons(spark, sf)
    return rounded(lb.auto_label(people, lb.person_profiles(people)), "similarity", "confidence")


@query("auto_label_summary", with_ctes("people", f"WITH {AUTO} SELECT count(*) AS total, count(person) AS labeled, count(*) FILTER (WHERE confidence > 0.8) AS high_confidence FROM au"))
def auto_label_summary(spark, sf):
    people = persons(spark, sf)
    return lb.auto_label_summary(lb.auto_label(people, lb.person_profiles(people)))


@query("pair_classifier", with_ctes("people", "SELECT p.ord, p.vec_id = q.vec_id AS same FROM people p JOIN people q ON q.ord = p.ord + 1"))
def pair_classifier(spark, sf):
    """Verdicts on neighbouring rows by a model fitted on labelled pairs; the check knows which are copies of one vector."""
    people = fx.people(spark, sf).withColumnRenamed("vec_id", "mega_id")
    return lb.classify_neighbours(people, lb.fit_pair_model(people)).select("ord", "same")


# ---- crops ----
CROPS = """cr AS (SELECT concat(regexp_replace(video_filename, '\\.[^.]*$', ''), printf('_frame-%06d_', frame_number),
    CASE WHEN ord % 11 = 0 THEN printf('detect-%03d', CAST(track_id AS INT)) WHEN ord % 13 = 0 THEN concat('detect-', frame_number) ELSE printf('track-%03d', CAST(track_id AS INT)) END, '.jpg') AS crop,
    ord FROM people WHERE ord % 7 <> 0)"""


def crop_files(spark, sf):
    """Crop names of most embeddings; some under the detection pattern, some under the frame number only, some missing."""
    number = F.format_string("%03d", F.col("track_id").cast("int"))
    ident = (
        F.when(F.col("ord") % 11 == 0, F.concat(F.lit("det_"), number)).when(F.col("ord") % 13 == 0, F.concat(F.lit("det_"), F.col("frame_number").cast("string"))).otherwise(number)
    )
    kept = fx.people(spark, sf).filter("ord % 7 <> 0")
    return kept.select(crop_name(F.col("video_filename"), F.col("frame_number"), ident).alias("crop")).distinct()


@query("match_crops", with_ctes("people", f"""WITH {CROPS}, c AS (SELECT DISTINCT crop, regexp_extract(crop, '^(.*)_frame-', 1) AS video, CAST(regexp_extract(crop, '_frame-([0-9]+)_', 1) AS INT) AS frame,
    regexp_extract(crop, '_(track|detect)-', 1) AS kind, CAST(regexp_extract(crop, '([0-9]+)\\.jpg$', 1) AS BIGINT) AS num FROM cr),
  m AS (SELECT p.ord, c.crop, CASE WHEN kind = 'track' AND num = CAST(track_id AS BIGINT) THEN 1 WHEN kind = 'detect' AND num = CAST(track_id AS BIGINT) THEN 2 WHEN kind = 'detect' AND num = frame_number THEN 3 END AS rank
    FROM people p JOIN c ON c.video = replace(p.video_filename, '.mp4', '') AND c.frame = p.frame_number)
  SELECT p.ord, b.crop, CAST(b.rank AS INT) AS rank FROM people p LEFT JOIN (SELECT ord, crop, rank FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY rank, crop) AS rn FROM m WHERE rank IS NOT NULL) WHERE rn = 1) b USING (ord)"""))
def match_crops(spark, sf):
    return crops.match_crops(fx.people(spark, sf), crop_files(spark, sf)).select("ord", "crop", "rank")

"""Queries of the training-data problems and, where SQL can say them on whole tables, the same in SQL."""

from __future__ import annotations

from vellum.llm import consolidate, mixture, near_images, spam, splits, tokens


def queries() -> dict:
    return {
        "p1_found": near_images.p1_found,
        "p1_groups": near_images.p1_groups,
        "p2_found": splits.p2_found,
        "p2_splits": splits.p2_splits,
        "p2_shares": splits.p2_shares,
        "p2_audit": splits.p2_audit,
        "p3_found": consolidate.p3_found,
        "p3_groups": consolidate.p3_groups,
        "p5_found": near_images.p5_found,
        "p5_report": near_images.p5_report,
        "p6_ids": tokens.p6_ids,
        "p6_decoded": tokens.p6_decoded,
        "p7_found": mixture.p7_found,
        "p7_mixture": mixture.p7_mixture,
        "p7_shares": mixture.p7_shares,
        "p7_overlap": mixture.p7_overlap,
        "p7_audit": mixture.p7_audit,
        "p8_found": spam.p8_found,
        "p8_scores": spam.p8_scores,
    }


def _label(column: str) -> str:
    return f"nullif(replace(lower(trim({column})), '-', '_'), '')"


_HEX = r"regexp_replace(regexp_replace(lower(phash), '[\s:-]', '', 'g'), '^0x', '')"
_SHA = r"regexp_replace(lower(trim(sha256)), '^sha256:\s*', '')"

#: images(image_id, bits): one row per image with a readable phash.
IMAGES = f"""images AS (SELECT DISTINCT image_id, ('0x' || {_HEX})::UBIGINT AS bits FROM duplicate_groups
  WHERE image_id IS NOT NULL AND regexp_full_match({_HEX}, '[0-9a-f]{{16}}') AND {_HEX} <> '{"0" * 16}')"""
HASH_PAIRS = """hashes AS (SELECT DISTINCT bits FROM images),
 near AS (SELECT a.bits AS a, b.bits AS b FROM hashes a JOIN hashes b ON a.bits < b.bits WHERE bit_count(xor(a.bits, b.bits)) <= 8)"""
IMAGE_PAIRS = """pairs AS (SELECT least(x.image_id, y.image_id) AS image_id_a, greatest(x.image_id, y.image_id) AS image_id_b
    FROM near JOIN images x ON x.bits = near.a JOIN images y ON y.bits = near.b
  UNION SELECT x.image_id, y.image_id FROM images x JOIN images y ON x.bits = y.bits AND x.image_id < y.image_id)"""
SIDES = f"""sides AS (SELECT image_id, min(CASE WHEN {_label("role")} = 'd_development' THEN 1 ELSE 2 END) AS side,
    arg_min({_label("role")}, (CASE WHEN {_label("role")} = 'd_development' THEN 1 ELSE 2 END, {_label("role")})) AS role
  FROM canonical_splits WHERE {_label("role")} IN ('d_development', 'd_test', 'd_stability', 'd_case_study') AND image_id IS NOT NULL GROUP BY 1),
 shas AS (SELECT DISTINCT image_id, {_SHA} AS sha FROM duplicate_groups
  WHERE image_id IS NOT NULL AND length({_SHA}) = 64 AND {_SHA} <> 'e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855'),
 crossing AS (SELECT t.image_id AS train_id, e.image_id AS eval_id, max(exact) AS exact FROM
    (SELECT image_id_a, image_id_b, 0 AS exact FROM pairs UNION ALL
     SELECT x.image_id, y.image_id, 1 FROM shas x JOIN shas y ON x.sha = y.sha AND x.image_id < y.image_id) p
    JOIN sides t ON t.side = 1 AND t.image_id IN (image_id_a, image_id_b) JOIN sides e ON e.side = 2 AND e.image_id IN (image_id_a, image_id_b) GROUP BY 1, 2)"""
#: grouped(image_id, group_key): components of images and labels; labels that read like an image's id tie that image.
GROUPED = f"""listed AS (SELECT DISTINCT image_id, {_label("duplicate_group_id")} AS label FROM duplicate_groups WHERE image_id IS NOT NULL AND {_label("duplicate_group_id")} IS NOT NULL),
 tied AS (SELECT image_id, label FROM listed UNION
  SELECT i.image_id, l.label FROM (SELECT DISTINCT image_id FROM duplicate_groups WHERE image_id IS NOT NULL) i JOIN (SELECT DISTINCT label FROM listed) l ON {_label("i.image_id")} = l.label),
 links AS (SELECT DISTINCT a.label AS u, b.label AS v FROM tied a JOIN tied b ON a.image_id = b.image_id AND a.label <> b.label),
 reach(v, label) AS (SELECT DISTINCT label, label FROM tied UNION SELECT links.v, reach.label FROM reach JOIN links ON links.u = reach.v),
 least AS (SELECT v, min(label) AS group_key FROM reach GROUP BY v),
 grouped AS (SELECT DISTINCT image_id, group_key FROM tied JOIN least ON least.v = tied.label)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {IMAGES}, {HASH_PAIRS}, {IMAGE_PAIRS} SELECT image_id_a, image_id_b FROM pairs",
        "p1_groups": f"""WITH RECURSIVE {IMAGES}, {HASH_PAIRS},
          signed AS (SELECT bits, CASE WHEN bits >= 9223372036854775808 THEN (bits::HUGEINT - 18446744073709551616)::BIGINT ELSE bits::BIGINT END AS s FROM hashes),
          e AS (SELECT a AS u, b AS v FROM near UNION ALL SELECT b, a FROM near),
          reach(v, label) AS (SELECT bits, bits FROM hashes UNION SELECT e.v, reach.label FROM reach JOIN e ON e.u = reach.v),
          class AS (SELECT v AS bits, min(s) AS class_id FROM reach JOIN signed ON signed.bits = reach.label GROUP BY v),
          links AS (SELECT u AS bits, count(*) AS n_links FROM e GROUP BY u)
          SELECT image_id, class_id, coalesce(n_links, 0) AS n_links FROM images JOIN class USING (bits) LEFT JOIN links USING (bits)""",
        "p2_found": f"""SELECT 'group' AS entity_kind, {_label("duplicate_group_id")} AS entity_key FROM canonical_splits WHERE fold <> -1 AND {_label("duplicate_group_id")} IS NOT NULL
            GROUP BY 2 HAVING count(DISTINCT fold) > 1
          UNION ALL SELECT 'seed', seed::VARCHAR FROM per_seed_external_metrics WHERE seed >= 0 GROUP BY seed HAVING count(DISTINCT {_label("generator")}) > 1""",
        # as units of one row are many, each split comes out on its share to the row
        "p2_shares": """WITH t AS (SELECT 'image' AS entity_kind, count(image_id)::DOUBLE AS n FROM canonical_splits UNION ALL SELECT 'seed', count(*) FROM per_seed_external_metrics WHERE seed >= 0),
            s AS (SELECT entity_kind, n, split, floor(share * n + 0.5)::BIGINT AS k FROM t, (VALUES ('validation', 0.15), ('test', 0.15)) v(split, share)),
            r AS (SELECT entity_kind, split, k AS rows, n FROM s UNION ALL SELECT entity_kind, 'train', (n - sum(k))::BIGINT, n FROM s GROUP BY entity_kind, n)
          SELECT entity_kind, split, rows, round(rows / n, 6) AS share FROM r""",
        "p2_audit": """SELECT 'image' AS entity_kind, count(DISTINCT image_id) AS n_entities, count(image_id) AS rows, 0 AS n_torn FROM canonical_splits
          UNION ALL SELECT 'seed', count(DISTINCT seed), count(*), 0 FROM per_seed_external_metrics WHERE seed >= 0""",
        "p3_found": f"WITH RECURSIVE {GROUPED} SELECT group_key, image_id FROM grouped WHERE group_key IN (SELECT group_key FROM grouped GROUP BY 1 HAVING count(*) > 1)",
        "p3_groups": f"WITH RECURSIVE {GROUPED} SELECT image_id, group_key FROM grouped",
        "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p7_audit": f"SELECT {_label('source')} AS source, target_share, 0 AS n_over_cap, 0 AS n_foreign, 0 AS n_beyond FROM mixture_targets",
        "p5_found": f"WITH {IMAGES}, {HASH_PAIRS}, {IMAGE_PAIRS}, {SIDES} SELECT least(train_id, eval_id) AS image_id_a, greatest(train_id, eval_id) AS image_id_b FROM crossing",
        "p5_report": f"""WITH {IMAGES}, {HASH_PAIRS}, {IMAGE_PAIRS}, {SIDES} SELECT role, split_part(eval_id, '_', 1) AS source, count(*) AS n_pairs, sum(exact)::BIGINT AS n_exact,
            count(DISTINCT eval_id) AS n_eval_images, count(DISTINCT train_id) AS n_train_images FROM crossing JOIN sides ON eval_id = image_id GROUP BY 1, 2""",
    }

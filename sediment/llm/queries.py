"""The queries of the nine problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import p1_syntax, p2_docs, p3_origin, p4_prose, p5_near, p6_secrets, p7_encode, p8_leaks, p9_spans
from .common import table as t

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: p1_syntax.invalid_files(t(s, d, "contents"), t(s, d, "files")).select("file_id").distinct(),
        "p1_errors": lambda s, d: p1_syntax.invalid_files(t(s, d, "contents"), t(s, d, "files")),
        "p1_rates": lambda s, d: p1_syntax.error_rates(t(s, d, "contents"), t(s, d, "files")),
        "p2_found": lambda s, d: p2_docs.documented(t(s, d, "contents"), t(s, d, "symbols"), t(s, d, "files"), with_code=False),
        "p2_pairs": lambda s, d: p2_docs.documented(t(s, d, "contents"), t(s, d, "symbols"), t(s, d, "files")),
        "p3_found": lambda s, d: p3_origin.not_hand_written(t(s, d, "contents"), t(s, d, "files")).select("file_id"),
        "p3_origins": lambda s, d: p3_origin.not_hand_written(t(s, d, "contents"), t(s, d, "files")),
        "p4_found": lambda s, d: p4_prose.prose(t(s, d, "contents"), t(s, d, "files"), t(s, d, "documents")).select("file_id", "lang"),
        "p4_shares": lambda s, d: p4_prose.prose(t(s, d, "contents"), t(s, d, "files"), t(s, d, "documents")),
        "p5_found": lambda s, d: p5_near.found(t(s, d, "chunks")),
        "p5_classes": lambda s, d: p5_near.classes(t(s, d, "chunks")),
        "p6_found": lambda s, d: p6_secrets.credentials(t(s, d, "contents")).select("file_id", "line_no").distinct(),
        "p6_credentials": lambda s, d: p6_secrets.credentials(t(s, d, "contents")),
        "p6_redacted": lambda s, d: p6_secrets.redacted(t(s, d, "contents"), "file_id", "path", "content"),
        "p6_chunks": lambda s, d: p6_secrets.redacted(t(s, d, "chunks"), "chunk_no", "file_path", "content"),
        "p7_ids": lambda s, d: p7_encode.encoded(t(s, d, "documents")),
        "p8_found": lambda s, d: p8_leaks.exact(t(s, d, "documents"), t(s, d, "eval_items")),
        "p8_near": lambda s, d: p8_leaks.leaks(t(s, d, "documents"), t(s, d, "eval_items")),
        "p9_found": lambda s, d: p9_spans.found(t(s, d, "documents")),
        "p9_members": lambda s, d: p9_spans.members(t(s, d, "documents")),
        "p9_shares": lambda s, d: p9_spans.shares(t(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    """Plain statements of the problems that SQL can give over whole tables; the others are tested by brute force."""
    shingles = """
      tok AS (SELECT DISTINCT chunk_no, regexp_extract_all(lower(substr(content, instr(content, chr(10)) + 1)), '[a-z0-9_]+') AS w
              FROM chunks WHERE symbol_type = 'function' AND content IS NOT NULL AND instr(content, chr(10)) > 0),
      sh AS (SELECT DISTINCT chunk_no, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM tok)"""
    pairs = f"""{shingles},
      n AS (SELECT chunk_no, count(*) AS n FROM sh GROUP BY 1),
      both_ AS (SELECT a.chunk_no AS a, b.chunk_no AS b, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.chunk_no < b.chunk_no GROUP BY 1, 2)"""
    return {
        "p5_found": f"""WITH {pairs}
            SELECT a AS chunk_no_a, b AS chunk_no_b FROM both_ JOIN n x ON x.chunk_no = a JOIN n y ON y.chunk_no = b
            WHERE k >= 0.7 * (x.n + y.n - k) - 1e-9""",
        "p5_classes": f"""WITH {shingles}, k AS (SELECT chunk_no, list(g ORDER BY g) AS gs FROM sh GROUP BY 1), c AS (SELECT gs, min(chunk_no) AS class_id, count(*) AS copies FROM k GROUP BY 1)
            SELECT chunk_no, class_id, copies FROM k JOIN c USING (gs)""",
        "p9_members": """WITH t AS (SELECT text, min(doc_id) AS class_id, count(*) AS copies FROM documents WHERE length(text) >= 400 GROUP BY 1 HAVING count(*) > 1) SELECT doc_id, class_id, copies FROM documents JOIN t USING (text)""",
        "p8_found": r"""WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
            iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
            dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM dw),
            ig AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM iw)
            SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
        "p9_found": """WITH g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, length(text) - 398), lambda i: hash(substr(text, i, 400)))) AS h FROM documents WHERE length(text) >= 400)
            SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM g a JOIN g b ON a.h = b.h AND a.doc_id < b.doc_id""",
    }

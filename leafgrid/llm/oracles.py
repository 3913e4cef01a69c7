"""DuckDB SQL of the text operators that SQL can express on whole tables in reasonable time."""

from __future__ import annotations

from .decontamination import LITERALS, MATCHED, NAME_MARK, NUMBERS, UNITS, WINDOW
from .jaccard_join import PERCENT, SHINGLE

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def jaccard_join() -> str:
    """Set sizes and components of all documents (ids are unique there)."""
    return f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
every AS (SELECT doc_id, unnest(CASE WHEN len(w) >= {SHINGLE} THEN list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sh AS (SELECT DISTINCT doc_id, s FROM every), sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= {PERCENT} * (x.n + y.n - k)),
reach(doc_id, got) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON r.got = l.a)
SELECT r.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(got) AS component_id FROM reach r LEFT JOIN sizes z ON z.doc_id = r.doc_id GROUP BY r.doc_id"""


def decontamination() -> str:
    """Matches of all documents with all items."""
    mark = f"chr({ord(NAME_MARK)})"
    units, numbers = (", ".join(f"'{u}'" for u in names) for names in (UNITS, NUMBERS))
    slot = f"CASE WHEN w >= '0' AND w <= '9~' OR w IN ({numbers}) THEN 1 WHEN starts_with(w, {mark}) THEN 2 WHEN w IN ({units}) THEN 3 ELSE 0 END"

    def cut(table: str, key: str) -> str:
        joined = "coalesce(text, '')"
        for _ in range(2):
            joined = f"regexp_replace({joined}, '([0-9]),([0-9]{{3}})', '\\1\\2', 'g')"
        marked = f"regexp_replace({joined}, '([\\p{{Ll}},;] )(\\p{{Lu}})', '\\1' || {mark} || '\\2', 'g')"
        return f"SELECT {key}, list_filter(string_split_regex(lower({marked}), '[^\\p{{L}}\\p{{N}}\\x01%$€£°]+'), lambda w: w <> '') AS w FROM {table}"

    def windows(name: str, key: str) -> str:
        return (
            f"{name}_t AS (SELECT {key}, w, list_transform(w, lambda w: {slot}) AS kind FROM {name}_w WHERE len(w) >= {WINDOW}), "
            f"{name}_a AS (SELECT *, unnest(range(0, len(w) - {WINDOW - 1})) AS pos FROM {name}_t), "
            f"{name} AS (SELECT {key}, pos, len(w) - {WINDOW - 1} AS m, w[pos + 1:pos + {WINDOW}] AS raw, kind[pos + 1:pos + {WINDOW}] AS kind, "
            f"list_transform(range(1, {WINDOW + 1}), lambda i: CASE WHEN kind[pos + i] > 0 THEN ' ' || kind[pos + i] ELSE w[pos + i] END) AS template FROM {name}_a)"
        )

    return f"""WITH d_w AS ({cut("documents", "doc_id")}), b_w AS ({cut("benchmark", "item_id")}), {windows("d", "doc_id")}, {windows("b", "item_id")},
known AS (SELECT * FROM b WHERE len(list_filter(kind, lambda k: k = 0)) >= {LITERALS}),
hit AS (SELECT doc_id, item_id, known.m AS m, d.pos - known.pos AS shift, d.raw AS x, known.raw AS y, known.kind AS kind FROM d JOIN known USING (template)),
found AS (SELECT doc_id, item_id, m, shift, count(*) AS n FROM hit GROUP BY ALL),
pairs AS (SELECT DISTINCT doc_id, item_id, shift, x[i] AS a, y[i] AS b FROM (SELECT *, unnest(range(1, {WINDOW + 1})) AS i FROM hit) WHERE kind[i] > 0),
fits AS (SELECT doc_id, item_id, shift, count(*) AS p, count(DISTINCT a) AS pa, count(DISTINCT b) AS pb, count(*) FILTER (WHERE a <> b) AS replaced FROM pairs GROUP BY ALL)
SELECT doc_id, item_id, CAST(sum(n) AS BIGINT) AS n_windows, min(coalesce(replaced, 0)) AS n_replaced FROM found LEFT JOIN fits USING (doc_id, item_id, shift)
WHERE coalesce(p = pa AND p = pb, true) GROUP BY doc_id, item_id, m HAVING sum(n) >= least({MATCHED}, m)"""

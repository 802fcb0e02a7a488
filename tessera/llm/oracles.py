"""DuckDB SQL for exact shingle containment, with no index at all."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of ASCII letters and digits and of anything beyond ASCII.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(source: str) -> str:
    return f"SELECT *, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM {source}"


_RUNS = "list_transform(range(1, len(w) - width + 2), lambda i: array_to_string(w[i:i + width - 1], ' '))"


def contained_sql(items: str, result: str) -> str:
    """Rows of documents that hold 0.8 of an item's distinct shingles; items: id, name, text."""
    return f"""
WITH t AS (SELECT *, least(len(w), 5) AS width FROM ({_words(items)}) WHERE len(w) > 0),
i AS (SELECT DISTINCT id, name, text, unnest({_RUNS}) AS s FROM t),
n AS (SELECT id, name, text, count(*)::INTEGER AS shingles FROM i GROUP BY ALL),
d AS (SELECT doc_id, s, min(pos)::INTEGER AS pos
      FROM (SELECT doc_id, unnest({_RUNS}) AS s, unnest(range(len(w) - width + 1)) AS pos
            FROM ({_words('documents')}), (SELECT DISTINCT width FROM t) WHERE len(w) >= width) GROUP BY ALL),
m AS (SELECT d.doc_id, i.id, i.name, i.text, count(*)::INTEGER AS shared, min(d.pos) AS first_word
      FROM d JOIN i USING (s) GROUP BY ALL)
SELECT {result} FROM m JOIN n USING (id, name, text) WHERE shared >= 0.8 * shingles - 1e-9
"""

"""Byte-level byte-pair encoding and decoding by recursive queries, one DuckDB a task.

A task splits its texts by the vocabulary's pattern and sends the distinct
pieces that its worker has not met to DuckDB.  There a recursive query holds a row for
each token and position; adjacent tokens join the merge table, and each piece
contracts its leftmost pair of least rank, until no pair has a rank.  Pieces at
rest leave the recursion.  An ordered aggregation gives ids, and a join with the
vocabulary, aggregated in order, the bytes: encoding and decoding of a text are
then the concatenation of its pieces'.

Where a piece is long, one contraction a step would take as many steps as it has
tokens.  But no token is longer than some number of bytes (``reach``, of the tokens
made of the piece's bytes).  A pair whose rank is least among all pairs that begin
within reach before it or after it is contracted by single steps before anything
can touch it: what could must first grow there from pairs of smaller rank, and
there are none.  So a step contracts every such pair.  Of equal ranks the leftmost
in reach goes, or, for merges that never yield a pair of smaller rank (``calm``),
every other one of each row of them from the left.  Steps then depend on
the reach, not on the length of the piece.

Null and empty texts have no tokens.  Repeated rows and null ids are rows of their
own; an empty table gives no rows; no other column is read.  A very long text is
split whole; its distinct pieces go to DuckDB by BATCH pieces or CHARS characters.
The cache of pieces is bounded; emptying it costs time only.
"""

from __future__ import annotations

import base64
import hashlib
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The white space of the pattern's \s, which Python's \s widens by four control characters.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CACHE = 1_000_000
#: Pieces of more tokens contract at several places in a step (at most 127, as a place has seven bits).
LONG = 100
#: Pieces of a query; documents and characters that are split at once.
BATCH, DOCS, CHARS = 60_000, 2048, 8_000_000
#: Characters of a query's pieces, unless one piece alone has more.
PIECE_CHARS = 1_000_000

#: Pieces as lists of tokens, one row for each, of which the recursion keeps the last.  A step unnests them into a row
#: for each position to join the merge table.  Short pieces: ``best`` is the least rank of a piece and, in its low seven
#: bits, the leftmost place that has it.  Long ones: the leftmost least rank of each stretch, see above.
ENCODE = """
WITH RECURSIVE t(w, toks, live) USING KEY (w) AS (
  SELECT w, list(tok ORDER BY pos), true FROM bytes GROUP BY w
  UNION ALL (
  SELECT t.w, CASE WHEN best IS NULL THEN toks ELSE toks[:(best & 127) - 1] || [(best >> 7)::INTEGER] || toks[(best & 127) + 2:] END, best IS NOT NULL
  FROM (SELECT w, toks FROM t WHERE live AND len(toks) <= {long}) t
  LEFT JOIN (
    SELECT w, min((m.rank::BIGINT << 7) + i) AS best
    FROM (SELECT w, unnest(list_transform(list_zip(toks[:-2], toks[2:]), lambda z: z[1]::BIGINT * 65536 + z[2])) AS ab, generate_subscripts(toks[:-2], 1) AS i
          FROM t WHERE live AND len(toks) <= {long}) p
    JOIN merges m USING (ab) GROUP BY w) b ON b.w = t.w
  UNION ALL
  SELECT w, list(tok ORDER BY i), bool_or(hit) FROM (
    SELECT w, i, hit, CASE WHEN hit THEN rank ELSE tok END AS tok, coalesce(lag(hit) OVER (PARTITION BY w ORDER BY i), false) AS gone FROM (
      SELECT w, i, tok, rank, coalesce(safe AND CASE WHEN calm
          THEN first_value(safe) OVER isle AND row_number() OVER isle % 2 = 1
          ELSE coalesce(before > rank, true) END, false) AS hit
      FROM (
        SELECT *, i - row_number() OVER (PARTITION BY w, rank ORDER BY i) AS island,
               rank = min(rank) OVER (PARTITION BY w ORDER BY pos RANGE BETWEEN reach PRECEDING AND 2 * reach FOLLOWING) AS safe,
               min(rank) OVER (PARTITION BY w ORDER BY pos RANGE BETWEEN reach PRECEDING AND 1 PRECEDING) AS before
        FROM (
          SELECT w, i, tok, reach, m.rank, m.calm, pos
          FROM (SELECT w, i, tok, v.reach, sum(size) OVER here - size AS pos, lead(tok) OVER here AS nxt
                FROM (SELECT w, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM t WHERE live AND len(toks) > {long})
                JOIN vocab ON id = tok JOIN reaches v USING (w) WINDOW here AS (PARTITION BY w ORDER BY i)) p
          LEFT JOIN merges m ON m.ab = tok::BIGINT * 65536 + nxt))
      WINDOW isle AS (PARTITION BY w, rank, island ORDER BY i)))
  WHERE NOT gone GROUP BY w))
SELECT w, toks FROM t
"""

ORDERED = """
  SELECT a.w, array_to_string(a.toks, ' ') AS ids, d.hex
  FROM final a JOIN (
    SELECT w, string_agg(v.hex, '' ORDER BY pos) AS hex
    FROM (SELECT w, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM final) JOIN vocab v ON v.id = tok GROUP BY w) d ON d.w = a.w
"""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def splitter(pattern: str):
    import regex

    inside = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACE}\p{{L}}\p{{N}}]").replace(r"\S", rf"[^{SPACE}]")
    return regex.compile(inside.replace(r"\s", f"[{SPACE}]")).findall


class Codec:
    """A DuckDB with the merge table; ``add`` encodes and decodes pieces that are not cached yet."""

    def __init__(self, ranks: dict[bytes, int]):
        import tempfile

        import duckdb

        self.ids: dict[str, bytes] = {}
        self.raw: dict[str, bytes] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": tempfile.mkdtemp(prefix="bpe-")})
        one = [ranks[bytes([b])] for b in range(256)]
        merges, unsafe = [], set()
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    merges.append((a, b, rank))
                    unsafe.update(x for x in (a, b) if x > rank)
        a, b, rank = zip(*merges)
        self._table("merges", a=a, b=b, rank=rank)
        self._table("unsafe", id=sorted(unsafe))
        self.db.execute("ALTER TABLE merges ADD COLUMN ab BIGINT; ALTER TABLE merges ADD COLUMN calm BOOLEAN")
        self.db.execute("UPDATE merges SET ab = a::BIGINT * 65536 + b, calm = rank NOT IN (SELECT id FROM unsafe)")
        self._table("vocab", id=list(ranks.values()), size=[len(t) for t in ranks], hex=[t.hex() for t in ranks])
        self._table("single", byte=list(range(256)), tok=one)
        # For reach: of each set of bytes that tokens are made of its longest token, longest first.
        longest: dict[frozenset, int] = {}
        for token in ranks:
            k = frozenset(token)
            longest[k] = max(len(token), longest.get(k, 0))
        self.longest = sorted(longest.items(), key=lambda x: -x[1])

    def reach(self, piece: bytes) -> int:
        mine = set(piece)
        return next(n for bytes_, n in self.longest if bytes_ <= mine)

    def _table(self, name: str, **columns) -> None:
        given = pa.table({k: pa.array(v, pa.string() if k == "hex" else pa.int32()) for k, v in columns.items()})
        self.db.register("given", given)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def add(self, pieces: list[str]) -> bool:
        """True if the cache had to be emptied first."""
        full = bool(self.ids) and len(self.ids) + len(pieces) > CACHE
        if full:
            self.ids.clear()
            self.raw.clear()
        self._fill(pieces)
        return full

    def meet(self, pieces: set[str]) -> None:
        """All of ``pieces`` are cached afterwards, even if they alone are more than CACHE."""
        if self.add(list(pieces.difference(self.ids))):  # the cache was emptied: the others again, with no more emptying
            self._fill(list(pieces.difference(self.ids)))

    def _fill(self, pieces: list[str]) -> None:
        batch, held = [], 0
        for p in pieces:
            if batch and (len(batch) == BATCH or held + len(p) > PIECE_CHARS):
                self._add(batch)
                batch, held = [], 0
            batch.append(p)
            held += len(p)
        if batch:
            self._add(batch)

    def _add(self, pieces: list[str]) -> None:
        import numpy as np

        coded = [x.encode() for x in pieces]
        size = np.array([len(x) for x in coded], np.int64)
        w = np.repeat(np.arange(len(coded), dtype=np.int32), size)
        pos = (np.arange(len(w)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
        given = pa.table({"w": w, "pos": pos, "byte": np.frombuffer(b"".join(coded), np.uint8).astype(np.int32)})
        wide = np.flatnonzero(size > LONG)
        db = self.db
        db.register("given", given)
        self._table("reaches", w=wide, reach=[self.reach(coded[i]) for i in wide])
        db.execute("CREATE OR REPLACE TEMP TABLE bytes AS SELECT w, pos, tok FROM given JOIN single USING (byte)")
        db.execute(f"CREATE OR REPLACE TEMP TABLE final AS {ENCODE.format(long=LONG)}")
        for k, ids, raw in db.execute(ORDERED).fetchall():
            self.ids[pieces[k]] = ids.encode()
            self.raw[pieces[k]] = bytes.fromhex(raw)
        db.unregister("given")


_CODECS: dict[str, Codec] = {}


def codec_for(ranks_path: str) -> Codec:
    """The worker's codec: tasks that it runs one after the other share the pieces that they have met."""
    if ranks_path not in _CODECS:
        _CODECS[ranks_path] = Codec(load_ranks(ranks_path))
    return _CODECS[ranks_path]


def chunks(column: pa.Array):
    """Ranges of rows of at most DOCS texts and about CHARS characters."""
    import pyarrow.compute as pc

    at, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if i > at and (i - at >= DOCS or held + n > CHARS):
            yield at, i
            at, held = i, 0
        held += n
    if at < len(column):
        yield at, len(column)


def looked_up(table: dict[str, bytes], pieces: list[str]):
    return itemgetter(*pieces)(table) if len(pieces) > 1 else [table[p] for p in pieces]


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), and with ``keep_ids`` the ids and the decoded text."""
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"))

    def run(batches):
        split, codec = splitter(pattern), codec_for(ranks_path)
        for batch in batches:
            col = batch.column(1)
            for i, j in chunks(col):
                texts = [t or "" for t in col.slice(i, j - i).to_pylist()]
                # The distinct new pieces of many texts go into one query.
                parts = [split(t) for t in texts]
                codec.meet(set().union(*parts))
                ids = [b" ".join(looked_up(codec.ids, p)) for p in parts]
                raw = [b"".join(looked_up(codec.raw, p)) for p in parts]
                cols = [batch.column(0).slice(i, len(texts)), pa.array([x.count(b" ") + 1 if x else 0 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in raw])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    cols += [pa.array([[int(y) for y in x.split()] for x in ids], pa.list_(pa.int32())), pa.array([x.decode() for x in raw])]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else ""))

"""Scoring one block of documents against one block of queries inside a task."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd

from profilum.functions.vectors import unit_rows

SLICE = 2048
PAIRS = 65_536
DIGITS = 12
# Scores are compared after rounding, so a cut must not lose what rounds up to it.
SLACK = 10.0 ** -(DIGITS - 1)
# Pairs are sifted in single precision, then scored in double: how far a product of unit vectors may be off, by a component.
COARSE = 2.0**-23
COLUMNS = ["query", "doc", "score"]


def query_rows(frame: pd.DataFrame, dimension: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Unit vectors and excluded ids of a block of queries; a missing vector, or one of another dimension
    than the documents, scores zero everywhere."""
    empty = np.zeros(dimension)
    rows = unit_rows([empty if vector is None or len(vector) != dimension else vector for vector in frame["query_vector"]])
    counts = frame["excludes"].to_numpy(dtype=bool)
    if not counts.any():
        return rows, None
    excluded = frame["exclude_id"].to_numpy(dtype=object)
    excluded[~counts] = None
    return rows, excluded


def hit_frame(query_ids, key: str, best: pd.DataFrame) -> pd.DataFrame:
    """The best rows under the ids of their queries, as plain object columns for Arrow."""
    at = best["query"].to_numpy(dtype=int)
    return pd.DataFrame({
        "query_id": pd.Series(np.asarray(query_ids, dtype=object)[at], dtype=object),
        key: pd.Series(best["doc"].to_numpy(dtype=object), dtype=object),
        "similarity_score": best["score"].to_numpy(dtype=np.float64),
    })


def best_rows(found: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows per query: higher score first, then smaller document id."""
    ordered = found.sort_values(["query", "score", "doc"], ascending=[True, False, True], kind="stable")
    return ordered.groupby("query", sort=False).head(k)


def scan(queries: np.ndarray, excluded, blocks: Iterable[tuple[np.ndarray, np.ndarray]], k: int) -> pd.DataFrame:
    """Top k of every query over a stream of (ids, unit vectors) blocks, keeping only the running best.

    ``excluded`` holds one document id or None per query that must not be returned, or is None.
    """
    best = pd.DataFrame(columns=COLUMNS)
    # Ordering costs more than scoring, so what is found waits until it is as much as the best rows are.
    waiting, held = [], 0
    floor = np.full(len(queries), -np.inf)
    excluding = [] if excluded is None else [number for number, doc in enumerate(excluded) if doc is not None]
    coarse = queries.astype(np.float32)
    slack = np.float32(SLACK + COARSE * (queries.shape[1] + 4))
    # Products with components that are no numbers are not ordered; such vectors score zero, like those without length.
    plain = np.isfinite(queries).all()
    for all_ids, all_rows in blocks:
        for first in range(0, len(all_ids), SLICE):
            ids, rows = all_ids[first : first + SLICE], all_rows[first : first + SLICE]
            scores = coarse @ rows.astype(np.float32).T
            if not (plain and np.isfinite(rows).all()):
                scores = np.nan_to_num(scores, nan=0.0)
            if excluding:
                same = pd.merge(
                    pd.DataFrame({"doc": np.array([excluded[number] for number in excluding], dtype=ids.dtype), "query": excluding}),
                    pd.DataFrame({"doc": ids, "column": np.arange(len(ids))}),
                    on="doc",
                )
                scores[same["query"].to_numpy(), same["column"].to_numpy()] = -np.inf
            cut = floor
            if len(ids) > k and not np.isfinite(floor).all():
                cut = np.maximum(floor, np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k] - slack)
            # Rounded down, so that the cut in single precision is no higher.
            lowest = np.maximum(np.nextafter((cut - slack).astype(np.float32), np.float32(-np.inf)), np.finfo(np.float32).min)
            at_query, at_row = np.divmod(np.flatnonzero(scores >= lowest[:, None]), len(ids))
            if not len(at_query):
                continue
            exact = np.concatenate([
                np.nan_to_num(np.einsum("ij,ij->i", queries[at_query[low : low + PAIRS]], rows[at_row[low : low + PAIRS]]), nan=0.0) for low in range(0, len(at_query), PAIRS)
            ])
            near = exact >= floor[at_query] - SLACK
            found = pd.DataFrame({"query": at_query[near], "doc": ids[at_row[near]], "score": np.round(exact[near], DIGITS)})
            if found.empty:
                continue
            waiting.append(found)
            held += len(found)
            if held < k * len(queries):
                continue
            best, waiting, held = best_rows(pd.concat([best, *waiting] if len(best) else waiting), k), [], 0
            counts = best.groupby("query")["score"].agg(["size", "min"])
            full = counts[counts["size"] >= k]
            floor[full.index.to_numpy(dtype=int)] = full["min"].to_numpy()
    return best_rows(pd.concat([best, *waiting] if len(best) else waiting), k) if waiting else best


def scan_lists(query_lists, queries: np.ndarray, excluded, doc_lists, ids: np.ndarray, rows: np.ndarray, k: int) -> pd.DataFrame:
    """Top k of every query among the documents of the lists it names. Documents name one list each."""
    asked = pd.DataFrame({"list": np.concatenate(query_lists), "query": np.repeat(np.arange(len(query_lists)), [len(lists) for lists in query_lists])})
    held = pd.DataFrame({"list": np.concatenate(doc_lists)}).groupby("list").indices
    found = []
    for number, at in asked.groupby("list")["query"]:
        at_row, at_query = held.get(number), at.to_numpy()
        if at_row is None:
            continue
        own = None if excluded is None else np.asarray(excluded, dtype=object)[at_query]
        block = scan(queries[at_query], own, [(ids[at_row], rows[at_row])], k)
        found.append(block.assign(query=at_query[block["query"].to_numpy(dtype=int)]))
    return best_rows(pd.concat(found), k) if found else pd.DataFrame(columns=COLUMNS)


def scan_scopes(query_scopes, queries: np.ndarray, excluded, doc_scopes, ids: np.ndarray, rows: np.ndarray, k: int) -> pd.DataFrame:
    """Top k of every query among the documents of its own scope.

    Scopes with few pairs are scored together, pair by pair; the others as blocks.
    """
    left = pd.DataFrame({"scope": query_scopes}).groupby("scope").indices
    right = pd.DataFrame({"scope": doc_scopes}).groupby("scope").indices
    found, pairs, waiting = [], [], 0

    def score_pairs():
        at_query = np.concatenate([a for a, _ in pairs])
        at_row = np.concatenate([b for _, b in pairs])
        if excluded is not None:
            other = np.asarray(excluded, dtype=object)[at_query] != ids[at_row]
            at_query, at_row = at_query[other], at_row[other]
        scores = np.nan_to_num(np.einsum("ij,ij->i", queries[at_query], rows[at_row]), nan=0.0)
        found.append(best_rows(pd.DataFrame({"query": at_query, "doc": ids[at_row], "score": np.round(scores, DIGITS)}), k))

    for scope, at_query in left.items():
        at_row = right.get(scope)
        if at_row is None:
            continue
        if len(at_query) * len(at_row) > SLICE:
            own = None if excluded is None else np.asarray(excluded, dtype=object)[at_query]
            block = scan(queries[at_query], own, [(ids[at_row], rows[at_row])], k)
            found.append(block.assign(query=at_query[block["query"].to_numpy(dtype=int)]))
            continue
        pairs.append((np.repeat(at_query, len(at_row)), np.tile(at_row, len(at_query))))
        waiting += len(at_query) * len(at_row)
        if waiting >= 50_000:
            score_pairs()
            pairs, waiting = [], 0
    if pairs:
        score_pairs()
    return pd.concat(found) if found else pd.DataFrame(columns=COLUMNS)

"""Boolean retrieval: a query compiles to one predicate over flags.

Grammar.  AND, OR and NOT in any case; words side by side are joined by an
implicit AND.  OR binds tighter than AND and NOT tightest, equal operators
group to the right, and an implicit AND never takes what waits on the stack.
NOT means "without" and needs something before it: alone it gives nothing.
An operator that lacks operands is passed over; a query that doesn't reduce to
one expression has no result.  ``standard=True`` gives the usual grammar
instead (AND over OR, left to right); NOT still means "without" there, so that
``a OR NOT b`` is ``a``: no query lists the documents that hold none of its terms.
``parens=True`` reads parentheses, which are otherwise dropped.

Plan.  Every set operation is pointwise in the document, so the whole query is
a condition on which of its terms a document holds: the postings of its terms
are read once and grouped by document, with a flag for each term.  Only
documents that hold a term of the query can satisfy it.
"""

from __future__ import annotations

import enum
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.stem import stem
from quarry.functions.text import DEFAULT, Profile


class Op(enum.IntEnum):
    """In order of precedence."""

    AND = 0
    OR = 1
    NOT = 2
    PAREN = 3


@dataclass(frozen=True)
class Word:
    text: str


@dataclass(frozen=True)
class Not:
    of: Node


@dataclass(frozen=True)
class And:
    """``last`` was written after ``first``."""

    last: Node
    first: Node


@dataclass(frozen=True)
class Or:
    last: Node
    first: Node


Node = Word | Not | And | Or
_WORDS = re.compile(r"[^\W_]+")
_WITH_PARENS = re.compile(r"[^\W_]+|[()]")


def _reduce(out: list[Node], op: Op) -> None:
    if op == Op.NOT and out:
        out.append(Not(out.pop()))
    elif op in (Op.AND, Op.OR) and len(out) > 1:
        last, first = out.pop(), out.pop()
        out.append((And if op == Op.AND else Or)(last, first))


def parse(query: str, parens: bool = False, standard: bool = False) -> Node | None:
    """The expression of a query, None if there is no single one."""
    words = (_WITH_PARENS if parens else _WORDS).findall(query)
    rank = {Op.OR: 0, Op.AND: 1, Op.NOT: 2} if standard else {op: int(op) for op in Op}
    out: list[Node] = []
    waiting: list[Op] = []

    def push(op: Op) -> None:
        while waiting and waiting[-1] != Op.PAREN:
            tighter = rank[op] < rank[waiting[-1]]
            same = standard and op != Op.NOT and rank[op] == rank[waiting[-1]]
            if not (tighter or same):
                break
            _reduce(out, waiting.pop())
        waiting.append(op)

    for i, word in enumerate(words):
        upper = word.upper()
        after = words[i + 1].upper() if i + 1 < len(words) else None
        if upper in ("AND", "OR", "NOT"):
            push(Op[upper])
            continue
        if word == "(":
            waiting.append(Op.PAREN)
            continue
        if word == ")":
            while waiting and (op := waiting.pop()) != Op.PAREN:
                _reduce(out, op)
        else:
            out.append(Word(word))
        joins = after is not None and after not in ("AND", "OR", ")") and (after != "(" or parens)
        if joins:
            if standard:
                push(Op.AND)
            else:
                waiting.append(Op.AND)
    while waiting:
        _reduce(out, waiting.pop())
    return out[0] if len(out) == 1 else None


def leaves(node: Node) -> list[str]:
    """The words of an expression, each once, in order."""
    match node:
        case Word(text):
            return [text]
        case Not(of):
            return leaves(of)
        case And(last, first) | Or(last, first):
            return list(dict.fromkeys(leaves(first) + leaves(last)))


def condition(node: Node, flags: dict[str, Column], before: Column) -> Column:
    """Whether a document is in the result, given whether it is in ``before``,
    from which NOT takes away."""
    match node:
        case Word(text):
            return flags[text]
        case Not(of):
            return before & ~condition(of, flags, F.lit(False))
        case Or(last, first):
            return condition(last, flags, before) | condition(first, flags, before)
        case And(last, first):
            if isinstance(last, Not) and not isinstance(first, Not):
                last, first = first, last
            found = condition(last, flags, before)
            return found & condition(first, flags, found)


def term_of(word: str, profile: Profile) -> str:
    word = word.lower() if profile.lowercase else word
    return stem(word) if profile.stem and len(word.encode()) > 3 else word


def boolean_search(postings: DataFrame, query: str, profile: Profile = DEFAULT, parens: bool = False, standard: bool = False) -> DataFrame:
    """``(doc_id)`` of all documents that satisfy ``query``. Stop words are
    looked up like other words."""
    node = parse(query, parens, standard)
    if node is None:
        return postings.select("doc_id").filter(F.lit(False))
    terms = {w: term_of(w, profile) for w in leaves(node)}
    distinct = list(dict.fromkeys(terms.values()))
    held = (
        postings.filter(F.col("term").isin(*distinct)).groupBy("doc_id")
        .agg(*[F.max(F.col("term") == t).alias(f"has_{k}") for k, t in enumerate(distinct)])
    )
    flags = {w: F.col(f"has_{distinct.index(t)}") for w, t in terms.items()}
    return held.filter(condition(node, flags, F.lit(False))).select("doc_id")


def evaluate(node: Node | None, sets: dict[str, set[int]], before: frozenset[int] = frozenset()) -> set[int]:
    """The same by set algebra on the driver; what the tests compare with."""
    match node:
        case None:
            return set()
        case Word(text):
            return set(sets.get(text, ()))
        case Not(of):
            return set(before) - evaluate(of, sets)
        case Or(last, first):
            return evaluate(last, sets, before) | evaluate(first, sets, before)
        case And(last, first):
            if isinstance(last, Not) and not isinstance(first, Not):
                last, first = first, last
            found = evaluate(last, sets, before)
            return found & evaluate(first, sets, frozenset(found))

"""Rules on how a question words its statement, as JVM expressions: what a question leaves open, what it asks to see, and the
first rule that a record breaks.

A record's statement comes as columns: table (name), select (column or *), conds (array of structs with col, op, val, val2,
vals) and whether it is sorted. Questions are compared in small letters. Null questions and statements break no rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifying and own-id columns, and the words that are read as cues.
IDENT = {"customers": "name", "items": "item_name", "orders": "order_id"}
OWN_ID = {"items": "item_id", "customers": "customer_id"}
STAR = r"\b(all|everything|every|full|whole|complete|entire|details?|info|information|records?|entry|entries|rows?|data|profile|lowdown|rundown|about|overview|summary|anything|columns?|fields?|on file|scoop|deal with|going on)\b"
NAMED = {
    "customers": r"\b(names?|named|called)\b", "items": r"\b(names?|named|called)\b", "orders": r"\b(order[ _]?ids?|order numbers?|ids?|numbers?)\b",
}
ID_WORD = r"\b(ids?|identifiers?|numbers?)\b|#"
OTHER_ID = r"\b(item|customer|product|client)[ _]?(ids?|numbers?)\b"
NAMING = r"\b(named|called|go(es)? by|with the names?|names? of)\b"
PLURAL = r"\b(items|products|orders|customers)\b|\b(articles|things|clients|members|patrons|shoppers|purchases|transactions|clothes|kitchen stuff|kitchenware|sports equipment|sports gear)\b"
LOOK_UP = r"\b(show|pull(ing)? up|look(ing)? ?up|look like|have on|what'?s up|what'?s in|what is in|story|tell me about)\b|\b(list|find|display|let me see|dig up|bring up|retrieve|enumerate|give me|get me|send me|provide|fetch|grab|get|fill me in)\b"
LEAD_IN = r"((and|so|ok|okay|hey|um|uh|well|hmm)\W+)?"
WHICH = rf"(^|[;:?–—-])\W*{LEAD_IN}(which|who)\b|,\s*which\b|\b(look up|find out|find|list|show( me)?|tell me|let me know|know|see|check|confirm|figure out|wondering)\s+(which|who)\b"
HAVE = r"(do|does) (we|you) ((even|really|actually|still) )?(have|carry|offer)"
EXISTS = rf"\b(is there|are there|there'?s|there (is|are)|exists?|existing|confirm\w*|verif\w*|check\w*|{HAVE}|we have (an?|any))\b|\bany\b.*\bat all\b"
EXISTS_FIRST = rf"^\W*{LEAD_IN}((can|could|would) you |please )?(is there|are there|{HAVE}|do any\b.*\bexist|(you )?got any|(confirm|verify|check)( if| whether)?( we have| there (is|are)))\b"
ORDERING = r"\b(orders?|ordered|ordering|purchases?|purchased|bought|buys?|transactions?|shipments?|shipped|deliver\w*|pending|cancel\w*)\b"


@dataclass(frozen=True)
class Worded:
    """The columns of a record."""

    question: Column
    table: Column
    select: Column
    conds: Column
    order: Column

    @property
    def q(self) -> Column:
        return F.replace(F.lower(F.trim(self.question)), F.lit("_"), F.lit(" "))

    @property
    def ident(self) -> Column:
        return F.coalesce(*[F.when(self.table == t, F.lit(c)) for t, c in IDENT.items()])

    def columns(self, *ops: str) -> Column:
        """Columns that the conditions restrict, by the given operators if any."""
        conds = F.coalesce(self.conds, F.array())
        return F.transform(F.filter(conds, lambda c: c["op"].isin(*ops)) if ops else conds, lambda c: c["col"])

    @property
    def asked(self) -> Column:
        """The question without the words that state conditions: the word id before an id's value, other tables' ids in questions
        on orders, and naming words where the identifying column is fixed."""
        id_cond = lambda c: c["col"].isin("customer_id", "item_id", "order_id")
        ids = F.flatten(F.transform(F.filter(F.coalesce(self.conds, F.array()), id_cond), lambda c: F.array_compact(F.concat(F.array(c["val"]), F.coalesce(c["vals"], F.array().cast("array<string>"))))))
        before = F.concat(F.lit(r"\b(?:ids?|numbers?|no\.?)\s*#?\s*("), F.array_join(ids, "|"), F.lit(r")\b"))
        q = F.when(F.size(ids) > 0, F.regexp_replace(self.q, before, F.lit(" $1"))).otherwise(self.q)
        q = F.when(self.table == "orders", F.regexp_replace(q, OTHER_ID, " ")).otherwise(q)
        return F.when(F.array_contains(self.columns("=", "IN"), self.ident), F.regexp_replace(q, NAMING, " ")).otherwise(q)

    def names_ident(self, q: Column) -> Column:
        return F.coalesce(*[F.when(self.table == t, q.rlike(cue)) for t, cue in NAMED.items()])


def ambiguous(w: Worded) -> Column:
    """True where the answer shows * or the identifying column and the question does not say which of the two."""
    shown = w.select.isin("*") | (w.select == w.ident)
    return shown & ~F.array_contains(w.columns("="), w.select) & ~w.asked.rlike(STAR) & ~w.names_ident(w.asked)


def default_projection(w: Worded) -> Column:
    """What a question without cue shows: * where the identifying column is fixed, that column after which or who, * for plural
    nouns and look-up verbs, else the identifying column."""
    q = w.asked
    fixed = F.array_contains(w.columns("=", "IN"), w.ident)
    return F.when(fixed, "*").when(q.rlike(WHICH), w.ident).when(q.rlike(PLURAL), "*").when(q.rlike(LOOK_UP), "*").otherwise(w.ident)


def broken_rule(w: Worded) -> Column:
    """The first rule that a flat record breaks, null for none: L1 existence without cue, L14 existence that shows rows, L2 another
    default projection, L3 own id unasked, L4 orders not named."""
    q, asked, cols = w.q, w.asked, w.columns()
    existence = (F.size(cols) == 1) & (w.columns("=") == cols) & (w.select == cols[0])
    asks = (F.size(cols) > 0) & w.order.isNull() & q.rlike(EXISTS_FIRST) & ~asked.rlike(STAR)
    own = F.coalesce(*[F.when(w.table == t, F.lit(c)) for t, c in OWN_ID.items()])
    keyed = (F.size(cols) > 0) & (F.size(F.array_except(cols, F.array(F.lit("customer_id"), F.lit("item_id")))) == 0)
    open_ = w.select.isin("*") | (w.select == w.ident)
    cued = asked.rlike(STAR) | w.names_ident(asked)
    return (
        F.when(w.question.isNull() | w.table.isNull() | w.select.isNull(), None)
        .when(existence, F.when(~q.rlike(EXISTS), "L1"))
        .when(asks & (w.select == w.ident), None)
        .when(asks & (w.select == "*"), "L14")
        .when(open_ & ~cued & (w.select != default_projection(w)), "L2")
        .when((w.select == own) & ~asked.rlike(ID_WORD), "L3")
        .when((w.table == "orders") & keyed & ((w.select == "*") | F.array_contains(cols, w.select)) & ~q.rlike(ORDERING), "L4")
    )


def soft_flags(w: Worded) -> Column:
    """Marks that deserve a look: stock asked in words of orders, quantity in words of stock, an existence query that asks for none."""
    q, cols = F.lower(w.question), w.columns()
    touches = lambda c: F.array_contains(cols, c) | (w.select == c)
    flags = [
        F.when(touches("stock") & q.contains("order") & ~q.rlike("stock|left|remain"), "stock in words of orders"),
        F.when(touches("quantity") & q.contains("stock"), "quantity in words of stock"),
        F.when(F.array_contains(cols, w.select) & ~q.rlike("is there|exist|confirm|verify|check"), "no words of existence"),
    ]
    return F.array_compact(F.array(*flags))

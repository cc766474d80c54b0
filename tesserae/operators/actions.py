"""Checks that go before an action and the results of the code functions, for all entities at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import approval_token, complexity

# Danger levels of the functions, and those that need no approval.
DANGER = {
    "query_entity": "read", "check_condition": "read", "check_refactor_eligibility": "read", "trace_call_chain": "read", "check_compliance": "read",
    "trace_business_impact": "read_sensitive",
    "update_entity": "write", "create_relation": "write", "send_notification": "write", "generate_api_doc": "write", "extract_interface": "write",
    "create_entity": "admin",
}
NEEDS_APPROVAL = ("read_sensitive", "write", "admin")
PENDING, TTL = 10, 600.0


def condition(field: Column, operator: str, value: Column) -> Column:
    """A comparison that raises where the field is missing and for operators it does not know."""
    known = {"==": field == value, ">": field > value, ">=": field >= value, "<": field < value, "!=": field != value}
    if operator not in known:
        raise ValueError(f"unknown operator {operator}")
    return F.when(field.isNull(), F.raise_error(F.lit("field is missing")).cast("boolean")).otherwise(known[operator])


def splits(lines: Column, branches: Column) -> Column:
    """Suggested parts of a large function, as name:lines."""
    third = (lines / 3).cast("int")
    rules = [(branches > 10, "_validate_inputs", F.least(F.lit(30), third)), (lines > 100, "_process_core", F.least(F.lit(40), third)), (lines > 200, "_handle_errors", F.least(F.lit(25), (lines / 5).cast("int")))]
    return F.filter(F.array(*[F.when(c, F.concat(F.lit(f"{name}:"), n.cast("string"))) for c, name, n in rules]), lambda x: x.isNotNull())


def eligible(entities: DataFrame, most: int = 100) -> DataFrame:
    """(id, lines, branches, complexity, splits) of entities (id, lines, branches) longer than `most`; null branches count as none."""
    e = entities.where(F.col("lines") > most).select("id", "lines", F.greatest(F.coalesce("branches", F.lit(0)), F.lit(0)).alias("branches"))
    return e.select("id", "lines", "branches", complexity(F.col("lines"), F.col("branches"), most).alias("complexity"), splits(F.col("lines"), F.col("branches")).alias("splits"))


def api_docs(entities: DataFrame) -> DataFrame:
    """(id, markdown) of entities (id, name, entity_type, params, returns, docstring); empty parts are left out."""
    name, doc = F.coalesce("name", "id"), F.col("docstring")
    params = F.when(F.size("params") > 0, F.concat(F.lit("**Parameters**:\n\n"), F.array_join(F.transform("params", lambda p: F.concat(F.lit("- `"), p, F.lit("`"))), "\n"), F.lit("\n")))
    parts = [
        F.concat(F.lit("## `"), name, F.lit("`\n")),
        F.concat(F.lit("**Type**: `"), F.coalesce("entity_type", F.lit("unknown")), F.lit("`\n")),
        params,
        F.when(F.coalesce("returns", F.lit("Any")) != "", F.concat(F.lit("**Returns**: `"), F.coalesce("returns", F.lit("Any")), F.lit("`\n"))),
        F.when(doc != "", F.concat(F.lit("**Description**: "), doc, F.lit("\n"))),
    ]
    return entities.select("id", F.concat_ws("\n", *parts).alias("markdown"))


def interfaces(methods: DataFrame) -> DataFrame:
    """(owner, interface, methods) from (owner, method): the sorted public methods, as stubs, under I and the owner's name."""
    per = methods.groupBy("owner").agg(F.array_sort(F.collect_set(F.when(~F.startswith("method", F.lit("_")), F.col("method")))).alias("m"))
    return per.select("owner", F.concat(F.lit("I"), "owner").alias("interface"), F.transform("m", lambda m: F.concat(F.lit("def "), m, F.lit("(self, *args, **kwargs)"))).alias("methods"))


def checked(decisions: DataFrame) -> DataFrame:
    """(id, block_reason, warnings) from (id, decision, suggestion): blocks give a reason, the others what to warn of."""
    said, text = F.col("suggestion"), lambda default: F.coalesce(F.nullif(F.col("suggestion"), F.lit("")), F.lit(default))
    warnings = F.when(F.col("decision") == "escalate", F.array(text("The operation needs approval."), F.lit("approval_required"))).when((F.col("decision") == "warn") & (said != ""), F.array(said)).otherwise(F.array().cast("array<string>"))
    return decisions.select("id", F.when(F.col("decision") == "block", text("The operation is blocked by a constraint.")).alias("block_reason"), warnings.alias("warnings"))


def approvals(requests: DataFrame, on_block: str = "require_approval", on_warn: str = "require_approval", danger: dict[str, str] | None = None) -> DataFrame:
    """requests (block_reason, warnings, requires_approval, function) with level: denied, pending or approved.

    Three policies: the shapes' outcome, the action's flag and the function's danger level, unknown functions counting as
    read. A denial wins, then anything pending.
    """
    levels = F.create_map(*[F.lit(x) for pair in (danger or DANGER).items() for x in pair])
    denied = F.col("block_reason").isNotNull() & F.lit(on_block == "auto_reject")
    warned = (F.size("warnings") > 0) & F.lit(on_warn == "require_approval")
    risky = F.coalesce(F.try_element_at(levels, F.col("function")), F.lit("read")).isin(*NEEDS_APPROVAL)
    waits = [F.col("block_reason").isNotNull(), warned, F.coalesce("requires_approval", F.lit(False)), risky]
    return requests.withColumn("level", F.when(denied, "denied").when(reduce(lambda a, b: a | b, waits), "pending").otherwise("approved"))


def gate(pending: DataFrame, now: float, ttl: float = TTL, most: int = PENDING) -> DataFrame:
    """(token, state) of pending approvals (token, at, used): used, expired, open, or denied beyond the `most` oldest open ones."""
    state = F.when(F.col("used"), "used").when(F.col("at") < now - ttl, "expired").otherwise("open")
    judged = pending.select("token", "at", state.alias("state"))
    # A top-k of bounded size: the tokens that may stay open.
    first = judged.where("state = 'open'").orderBy("at", "token").limit(most).select("token", F.lit(True).alias("first"))
    joined = judged.join(F.broadcast(first), "token", "left")
    return joined.select("token", F.when((F.col("state") == "open") & F.col("first").isNull(), "denied").otherwise(F.col("state")).alias("state"))


def consulted(functions: DataFrame, shapes: DataFrame) -> DataFrame:
    """(function, shape_id) of the shapes (shape_id, label, operation) that the functions' capabilities (function, capabilities) name."""
    named = functions.select("function", F.explode(F.array_distinct("capabilities")).alias("c"))
    parts = named.select("function", F.substring_index("c", ":", 1).alias("label"), F.upper(F.substring_index("c", ":", -1)).alias("operation"))
    return parts.join(shapes, ["label", "operation"]).select("function", "shape_id").distinct()


def step_approvals(steps: DataFrame, target: str, session: str, nonce: str) -> DataFrame:
    """steps (step, decision) of a plan with token: a one-time token for those to escalate, null for the others; blocked ones may not go on."""
    token = approval_token(F.concat(F.lit("dag:"), "step"), F.lit(target), F.lit(session), F.lit(nonce))
    return steps.withColumn("token", F.when(F.col("decision") == "escalate", token)).withColumn("may_proceed", ~F.col("decision").isin("block", "escalate"))


def resolved(pending: DataFrame, answers: DataFrame, now: float, ttl: float = TTL) -> DataFrame:
    """(token, action, approved, may_proceed) for the first answer (token, approved, at) to each token asked for (token, at).

    The rows are the log of the answers: rejected, resolved, expired, or unknown for tokens that were not asked for.
    Later answers to a token find it used.
    """
    known = pending.select("token", F.col("at").alias("asked"), F.lit(True).alias("known"))
    nth = F.row_number().over(Window.partitionBy("token").orderBy("at", "approved"))
    judged = answers.withColumn("nth", nth).join(known, "token", "left")
    action = F.when(F.col("known").isNull(), "unknown").when(F.col("nth") > 1, "used").when(F.col("asked") < F.col("at") - ttl, "expired").when(F.col("approved"), "resolved").otherwise("rejected")
    return judged.where(F.col("at") <= now).select("token", action.alias("action"), "approved", (action == "resolved").alias("may_proceed"))

"""Summaries of communities, domains and the whole, and answers put together within token budgets.

Prompts are assembled in column expressions, one row each; a text model is called row by row
in mapInPandas, so calls run in parallel and a failure is a value, not the end of a job.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import shortened, token_count
from ..model import TextModel
from ..sources.files import trimmed
from ..storage import ship
from .extract import reply_field, reply_score
from .links import keyword_domain
from .text import fitting

#: The message without evidence, and budgets of tokens.
NO_COMMUNITIES = "No relevant code communities were identified for this query."
CONTEXT, SYSTEM, RESERVE, NARRATIVE_RESERVE = 8000, 200, 1800, 6000
SNIPPETS, SUMMARIES = (CONTEXT - SYSTEM - RESERVE) * 5 // 10, (CONTEXT - SYSTEM - RESERVE) * 4 // 10
NARRATIVE_SNIPPETS, NARRATIVE_SUMMARIES = (CONTEXT - SYSTEM - NARRATIVE_RESERVE) * 4 // 10, (CONTEXT - SYSTEM - NARRATIVE_RESERVE) * 5 // 10
#: Domains by the words of their summaries; the first wins ties.
DOMAINS = [
    ("Authentication", ["authenticat", "login", "credential", "password", "basic auth", "identity provider", "idp", "local auth", "federated auth", "multi-factor", "mfa", "totp", "fido", "webauthn"]),
    ("OAuth2 / Token Management", ["oauth", "token", "access_token", "refresh_token", "bearer", "authorization code", "client_credentials", "grant", "token exchange", "jwt", "jws", "jwe", "opaque token", "introspect", "revoke", "consent"]),
    ("SCIM / User Management", ["scim", "user management", "user store", "provisioning", "group management", "role", "claim", "user profile"]),
    ("Federation / SSO", ["saml", "federation", "sso", "single sign-on", "identity federation", "assertion", "ws-federation", "trusted identity", "outbound provisioning"]),
    ("Session Management", ["session", "cookie", "session management", "idle timeout", "session termination", "remember me"]),
    ("Dynamic Client Registration", ["dcr", "dynamic client registration", "client registration", "service provider", "application registration"]),
    ("OpenID Connect", ["oidc", "openid connect", "id token", "userinfo", "discovery", "well-known", "claims"]),
    ("Configuration & Deployment", ["configuration", "deployment.toml", "tenant", "server config", "carbon", "registry", "governance"]),
    ("Data Persistence", ["dao", "database", "jdbc", "persistence", "data access", "sql", "table", "query", "repository pattern"]),
    ("Event Handling & Notifications", ["event", "listener", "handler", "notification", "publish", "subscribe", "observer", "callback"]),
    ("Utilities & Framework", ["util", "helper", "common", "base class", "abstract", "framework", "carbon kernel", "osgi", "service component"]),
]
OTHER = "Other / Uncategorized"


def call_model(rows: DataFrame, model: TextModel, max_tokens: int) -> DataFrame:
    """rows with reply and error: what the model says to each prompt; a failed call leaves reply null."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            said, failed = [], []
            for prompt in part["prompt"]:
                try:
                    said.append(model.call(prompt, max_tokens))
                    failed.append(None)
                except Exception as e:  # any fault of the model is that row's result
                    said.append(None)
                    failed.append(f"{type(e).__name__}: {e}")
            yield part.assign(reply=said, error=failed)

    ship(rows.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{fields}, reply string, error string")


def community_prompts(nodes: DataFrame, boundary: DataFrame, budget: int = 6800, edges_shown: int = 6) -> DataFrame:
    """(community_id, prompt, truncated): types, then methods of each community, and where its edges lead.

    nodes need community_id, label, fqn and docstring, boundary what graph.boundary() gives.
    Lines go from the end until the whole fits the budget, down to none.
    """
    own = nodes.where("label in ('Component', 'LogicUnit') and community_id is not null")
    said = F.when(F.col("label") == "Component", shortened(F.col("docstring"), 250)).otherwise(shortened(F.col("docstring"), 200))
    line = F.concat(F.lit("- "), F.col("fqn"), F.coalesce(F.concat(F.lit(": "), said), F.lit("")))
    lines = own.select("community_id", F.struct((F.col("label") != "Component").alias("later"), "fqn").alias("place"), line.alias("line"))
    led = boundary.where(F.col("rn") <= edges_shown).select("community_id", F.struct("rn", F.concat_ws(" ", F.lit("  "), "edge_type", F.lit("to community"), F.col("target_community").cast("string"), F.concat(F.lit("("), F.col("cnt").cast("string"), F.lit(")"))).alias("t")).alias("l"))
    led = led.groupBy("community_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["t"]), "\n").alias("edges"))
    head = "Summarise what this group of code does and how it is used."
    # Head, foot and joints are counted against the budget beforehand.
    fit = fitting(lines, "community_id", "place", "line", token_count(F.col("line")) + 1, budget - 120)
    out = fit.join(led, "community_id", "left")
    return out.select("community_id", F.concat_ws("\n", F.lit(head), "kept", F.lit("Edges to other groups:"), F.coalesce("edges", F.lit("  none"))).alias("prompt"), "truncated")


def summarise(prompts: DataFrame, names: DataFrame, model: TextModel, at: str, max_tokens: int = 400) -> tuple[DataFrame, DataFrame]:
    """(summaries, failures): community_id, summary_id, text, top_fqns as JSON, created_at; and the communities whose call failed."""
    said = call_model(prompts.select("community_id", "prompt", "truncated"), model, max_tokens).join(names, "community_id", "left")
    good = said.where("error is null").select("community_id", F.concat(F.lit("community_"), F.col("community_id").cast("string")).alias("summary_id"), F.col("reply").alias("text"), F.to_json(F.coalesce("top_fqns", F.array().cast("array<string>"))).alias("top_fqns"), "truncated", F.lit(at).alias("created_at"))
    return good, said.where("error is not null").select("community_id", "error")


def by_domain(summaries: DataFrame, domains: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    name, _ = keyword_domain(F.col("text"), domains or DOMAINS, OTHER)
    return summaries.withColumn("domain", name)


def domain_prompts(summaries: DataFrame, budget: int = CONTEXT - 400 - 2000, domains: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """(domain, community_count, community_ids, prompt): the summaries of each domain, by community, up to the first that no longer fits."""
    own = by_domain(summaries, domains).withColumn("line", F.concat(F.lit("Community "), F.col("community_id").cast("string"), F.lit(": "), F.col("text")))
    fit = fitting(own, "domain", "community_id", "line", token_count(F.col("line")), budget)
    ids = own.groupBy("domain").agg(F.count("*").alias("community_count"), F.array_sort(F.collect_list("community_id")).alias("community_ids"))
    return fit.join(ids, "domain").select("domain", "community_count", F.array_join(F.transform("community_ids", lambda x: x.cast("string")), ",").alias("community_ids"), F.concat(F.lit("Describe the subsystem "), "domain", F.lit(" from the summaries of its parts.\n"), "kept").alias("prompt"))


def global_prompt(domains: DataFrame, budget: int = CONTEXT - 400 - 3000) -> DataFrame:
    """One row (prompt, domains): the subsystems' texts, most communities first, up to the first that no longer fits."""
    rank = F.row_number().over(W.orderBy(F.desc("community_count"), "domain"))  # a row for each domain, a dozen
    own = domains.withColumn("rn", rank).withColumn("line", F.concat(F.col("domain"), F.lit(": "), F.col("text"))).withColumn("all", F.lit(0))
    fit = fitting(own, "all", "rn", "line", token_count(F.col("line")), budget)
    return fit.select(F.concat(F.lit("Describe the architecture of the whole system from its subsystems.\n"), "kept").alias("prompt"))


NO_SUMMARIES = "No community summaries are available."


def rollup(summaries: DataFrame, model: TextModel, at: str, domains: list[tuple[str, list[str]]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(subsystems, whole): (id, domain, community_count, community_ids, text, created_at) and one row (id, text, created_at); a fixed text without summaries."""
    spark = summaries.sparkSession
    second = call_model(domain_prompts(summaries, domains=domains), model, 2000).where("error is null").select(F.concat(F.lit("l2:"), "domain").alias("id"), "domain", "community_count", "community_ids", F.col("reply").alias("text"), F.lit(at).alias("created_at"))
    if summaries.isEmpty():
        return second, spark.createDataFrame([("l3:global_architecture", NO_SUMMARIES, at)], "id string, text string, created_at string")
    third = call_model(global_prompt(second), model, 3000).select(F.lit("l3:global_architecture").alias("id"), F.col("reply").alias("text"), F.lit(at).alias("created_at"))
    return second, third


def flow_prompts(flows: DataFrame, named: DataFrame, budget: int = 3000, keep: int = 10) -> DataFrame:
    """(id, entry, sink, prompt, truncated): steps of each flow in order, and the tables and keys that it reaches."""
    head = flows.select("entry", "sink", F.concat(F.lit("Tell the flow from "), "entry", F.lit(" to "), "sink").alias("line"), F.lit(0).alias("p"))
    step = named.select("entry", "sink", F.posexplode("names").alias("i", "n")).select("entry", "sink", F.concat(F.format_string("%d. ", F.col("i") + 1), "n").alias("line"), (F.col("i") + 1).alias("p"))
    foot = flows.select("entry", "sink", F.concat(F.lit("Tables: "), F.array_join("tables", ", "), F.lit("\nConfiguration: "), F.array_join("config_keys", ", ")).alias("line"), F.lit(1 << 20).alias("p"))
    lines = head.unionByName(step).unionByName(foot).withColumn("id", F.concat(F.lit("flow:"), "entry", F.lit("→"), "sink"))
    fit = fitting(lines, "id", "p", "line", token_count(F.col("line")) + 1, budget, keep)
    return flows.select("entry", "sink", F.concat(F.lit("flow:"), "entry", F.lit("→"), "sink").alias("id")).join(fit, "id").select("id", "entry", "sink", F.col("kept").alias("prompt"), "truncated")


def scored(pairs: DataFrame, model: TextModel, max_tokens: int = 200) -> DataFrame:
    """(question, community_id, score, reason, text): what a model gives each summary of pairs(question, community_id, text); zeros go, best first."""
    ask = F.concat(F.lit("Question: "), "question", F.lit("\nSummary: "), F.left("text", F.lit(3000)), F.lit('\nAnswer {"score": 0-100, "reason": "..."}'))
    said = call_model(pairs.withColumn("prompt", ask), model, max_tokens)
    return said.select("question", "community_id", reply_score(F.col("reply")).alias("score"), reply_field(F.col("reply"), "reason").alias("reason"), "text").where("score > 0").orderBy(F.desc("score"), "community_id")


def kept_scores(results: DataFrame, least: int = 50, otherwise: int = 10) -> DataFrame:
    """results(community_id, score, ...) of `least` and more; if none is, the first ones by score."""
    high = results.where(F.col("score") >= least)
    return high if not high.isEmpty() else results.orderBy(F.desc("score"), "community_id").limit(otherwise)


def summaries_text(results: DataFrame, budget: int = SUMMARIES) -> DataFrame:
    """One row (kept, truncated): kept_scores() best first, cut from the end to the budget, one at least."""
    rank = F.row_number().over(W.orderBy(F.desc("score"), "community_id"))  # a question's results, some dozens
    line = F.concat(F.lit("Community "), F.col("community_id").cast("string"), F.lit(" (score "), F.col("score").cast("string"), F.lit("/100)\n"), "text")
    own = kept_scores(results).withColumn("rn", rank).withColumn("line", line).withColumn("all", F.lit(0))
    return fitting(own, "all", "rn", "line", token_count(F.col("line")), budget, 1).select("kept", "truncated")


def snippets_text(snippets: DataFrame, budget: int = SNIPPETS) -> DataFrame:
    """One row (kept, truncated) of snippets(ord, file_path, code), in order, the first always."""
    own = snippets.withColumn("line", F.concat_ws("\n", trimmed(F.col("file_path")), "code")).withColumn("all", F.lit(0))
    return fitting(own, "all", "ord", "line", token_count(F.col("line")), budget, 1).select("kept", "truncated")


def nodes_text(nodes: DataFrame, most: int = 15) -> str:
    """The first nodes(fqn, file_path, edge_type) by fqn as a list."""
    via = F.when(F.length("edge_type") > 0, F.concat(F.lit("  via "), "edge_type")).otherwise("")
    rows = nodes.orderBy("fqn").limit(most).select(F.concat(F.lit("- "), "fqn", F.lit("  ("), trimmed(F.coalesce("file_path", F.lit(""))), F.lit(")"), via).alias("l")).collect()
    return "\n".join(r.l for r in rows) or "(none found)"


def grep_counts(hits: DataFrame, category: Column) -> DataFrame:
    """(category, n, files): hits(file_path, ...) by category, with up to four of their files."""
    return hits.withColumn("category", category).groupBy("category").agg(F.count("*").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set("file_path")), 1, 4), ",").alias("files"))


TASKS = {
    "code": "Show the code that was asked for and say what it does.",
    "safety": "Say whether the change is safe, from the usages listed.",
    "capability": "Say whether the code does this, and where.",
    "impact": "List what is affected, and how.",
    "narrative": "Tell the flow step by step.",
    "general": "Answer from the evidence.",
}


#: What each kind of answer reads first, and how its evidence is headed.
LAYOUTS = {
    "code": (("snippets", "Source"), ("evidence", "Where it is used"), ("summaries", "Background")),
    "safety": (("evidence", "Usages to check"), ("snippets", "Source of what changes"), ("summaries", "Areas around it")),
    "capability": (("summaries", "What the areas do"), ("evidence", "Methods that may do it"), ("snippets", "Source")),
    "impact": (("evidence", "What depends on it"), ("summaries", "Areas affected"), ("snippets", "Source")),
    "narrative": (("evidence", "Steps found"), ("snippets", "Source in order"), ("summaries", "Areas passed")),
    "general": (("summaries", "Summaries"), ("snippets", "Code"), ("evidence", "Graph")),
}


def prompt_for(question: str, intent: str, summaries: str, snippets: str, evidence: str) -> str:
    have = {"summaries": summaries, "snippets": snippets, "evidence": evidence}
    return "\n\n".join([TASKS[intent], f"Question: {question}", *(f"{head}:\n{have[name] or '(none)'}" for name, head in LAYOUTS[intent])])


def debug_prompt(error: str, frames: str, snippets: str, throw_sites: str) -> str:
    """What a model is asked for the cause of an error, from its frames, their source and the places that throw it."""
    parts = (("Error", error or "(not named)"), ("Stack frames", frames or "(none)"), ("Source at the frames", snippets or "(not in the store)"), ("Places that throw it", throw_sites or "(none found)"))
    return "\n\n".join(["Say what most likely caused this error, in which frame it began, and what to change.", *(f"{head}:\n{body}" for head, body in parts)])


def prompt_tokens(prompt: str) -> int:
    """Tokens as functions.columns.token_count() counts them."""
    import re

    return len(re.findall(r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]", prompt))


def reduce(question: str, intent: str, results: DataFrame | None, snippets: DataFrame | None, evidence: DataFrame | None, model: TextModel) -> dict:
    """The answer to a question: answer, intent, included evidence and tokens. Without any evidence a fixed message and no call.

    All inputs are a question's own rows, some dozens; the texts that are put together on the
    driver are cut to their budgets before.
    """
    none = lambda df: df is None or df.isEmpty()
    if none(results) and none(snippets) and none(evidence):
        return {"answer": NO_COMMUNITIES, "intent": intent, "tokens": 0, "called": False}
    long_ = intent == "narrative"
    told = "" if none(results) else summaries_text(results, NARRATIVE_SUMMARIES if long_ else SUMMARIES).first().kept
    code = "" if none(snippets) else snippets_text(snippets, NARRATIVE_SNIPPETS if long_ else SNIPPETS).first().kept
    prompt = prompt_for(question, intent, told, code, "(none found)" if none(evidence) else nodes_text(evidence))
    return {"answer": model.call(prompt, NARRATIVE_RESERVE if long_ else RESERVE), "intent": intent, "tokens": prompt_tokens(prompt), "called": True}


def analyse_change(question: str, summaries: DataFrame, near: list[int], model: TextModel) -> dict:
    """A change held against the summaries near it: answer, communities evaluated and kept."""
    results = scored(summaries.where(F.col("community_id").isin(near)).select(F.lit(question).alias("question"), "community_id", "text"), model)
    kept = results.count()
    if not kept:
        return {"answer": NO_COMMUNITIES, "evaluated": len(near), "communities_scored": 0}
    return {"answer": reduce(question, "impact", results, None, None, model)["answer"], "evaluated": len(near), "communities_scored": kept}

"""Screening of prompts, answers and documents by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchtide.functions.masking import mask_labels
from watchtide.functions.scoring import TIER_HIGH, TIER_MODERATE, confidence_tier
from watchtide.functions.text import fixed, has

# Actions that need approval, in the order they are looked for.
HIGH_IMPACT_ACTIONS = (
    "isolate_endpoint",
    "block_ip",
    "block_user",
    "disable_account",
    "revoke_credentials",
    "modify_security_controls",
    "shutdown_service",
    "change_detection_threshold",
    "execute_mitigation",
)
ABSOLUTE_CLAIMS = r"\b(always|never|definitely|certainly|guaranteed|100%)\b"

# Policy patterns over prompt and answer, each with its message.
AUTONOMOUS = "AUTONOMOUS_ACTION_DETECTED: AI must not execute actions autonomously"
SPECULATIVE = "SPECULATIVE_CLAIM: Response contains unsupported speculation"
POLICY_PATTERNS = (
    (r"\bexecuting\s+(block|isolate|disable|shutdown)\b", AUTONOMOUS),
    (r"\bautonomous\s+(mitigation|response|action)\b", AUTONOMOUS),
    (r"\bautomatically\s+(blocked|isolated|disabled)\b", AUTONOMOUS),
    (r"\bprobably\s+(a\s+)?(hack|attack|breach|exploit)\b", SPECULATIVE),
    (r"\bmight\s+be\s+(a\s+)?(hack|attack|breach)\b", SPECULATIVE),
)

# Boundaries and the patterns of answers that cross them.
ANSWER_BOUNDARIES = (
    (
        "BOUNDARY_001",
        (
            r"\b(blocking|blocked|will\s+block)\s+(ip|address|host)\b",
            r"\bip\s+(blocking|blacklist|firewall\s+rule)\s+(applied|executed|activated)\b",
        ),
    ),
    (
        "BOUNDARY_002",
        (
            r"\b(isolating|isolated|will\s+isolate)\s+(endpoint|host|machine|device)\b",
            r"\bendpoint\s+(quarantine|isolation)\s+(applied|executed)\b",
        ),
    ),
    (
        "BOUNDARY_003",
        (
            r"\b(disabling|disabled|will\s+disable)\s+(account|user|credential)\b",
            r"\baccount\s+(disabled|locked|suspended)\s+(automatically|now)\b",
        ),
    ),
    (
        "BOUNDARY_004",
        (
            r"\b(changing|changed|adjusted|modifying)\s+(threshold|sensitivity|detection\s+parameter)\b",
            r"\bthreshold\s+(set|changed|adjusted)\s+to\b",
        ),
    ),
    (
        "BOUNDARY_005",
        (
            r"\b(executing|executed|running)\s+(mitigation|remediation|countermeasure)\b",
            r"\bmitigation\s+(applied|deployed|executed|activated)\b",
        ),
    ),
    (
        "BOUNDARY_006",
        (
            r"\b(overriding|bypassing|escalating)\s+(rbac|permission|access\s+control|role)\b",
            r"\bprivilege\s+(escalation|elevation)\s+(applied|granted)\b",
        ),
    ),
    (
        "BOUNDARY_008",
        (
            r"""\b(api[_\s]?key|password|secret|credential|token)\s*[:=]\s*["']?[A-Za-z0-9_\-]{8,}""",
        ),
    ),
)
TENANT_PATTERNS = (
    r"\b(other\s+tenant|another\s+organization|tenant\s+\d+)\b",
    r"\baccess\s+(all|other)\s+(tenants?|organizations?|companies)\b",
)
UNSUPPORTED_PATTERNS = (
    r"\b(definitely|certainly|guaranteed|100%)\s+(a\s+)?(threat|attack|breach|exploit|vulnerability)\b",
    r"\b(confirmed|verified)\s+(that\s+this\s+is\s+a\s+)?(attack|breach|threat)\b",
)


def high_impact_action(prompt: Column, response: Column) -> Column:
    """The first listed action named in prompt or answer, with underscores or blanks."""
    text = F.lower(F.concat(prompt, F.lit(" "), response))
    return F.coalesce(
        *[
            F.when(
                F.contains(text, F.lit(a)) | F.contains(text, F.lit(a.replace("_", " "))), F.lit(a)
            )
            for a in HIGH_IMPACT_ACTIONS
        ]
    )


def hallucination_flag(response: Column, sources: Column, confidence: Column) -> Column:
    """No sources at low confidence, or absolute words with little behind them."""
    unsupported = (sources == 0) & (confidence < TIER_MODERATE)
    absolute = has(response, ABSOLUTE_CLAIMS) & (confidence < TIER_HIGH) & (sources < 2)
    return unsupported | absolute


def citation_check(response: Column, sources: Column) -> Column:
    """Sources the answer refers to: (valid, cited, uncited names).

    ``sources`` is an array of structs with filename, source and collection.
    """
    low = F.lower(response)
    general = (
        F.contains(low, F.lit("source"))
        | F.contains(low, F.lit("evidence"))
        | F.contains(low, F.lit("retrieved"))
    )

    def name(s: Column) -> Column:
        return F.coalesce(
            F.nullif(s["filename"], F.lit("")), F.nullif(s["source"], F.lit("")), F.lit("unknown")
        )

    missing = F.transform(
        F.filter(
            sources,
            lambda s: ~(
                general | F.contains(response, name(s)) | F.contains(response, s["collection"])
            ),
        ),
        name,
    )
    cited = F.size(sources) - F.size(missing)
    return F.struct(
        (cited > 0).alias("valid"), cited.alias("cited"), missing.alias("uncited")
    )


def policy_violations(prompt: Column, response: Column) -> Column:
    """One message per policy pattern found."""
    text = F.lower(F.concat(prompt, F.lit(" "), response))
    return F.array_compact(
        F.array(*[F.when(has(text, p), F.lit(m)) for p, m in POLICY_PATTERNS])
    )


def boundary_violations(prompt: Column, response: Column) -> Column:
    """Ids of the boundaries the answer, or prompt and answer, cross."""
    both = F.concat(prompt, F.lit(" "), response)
    tests = [F.when(has(response, *ps), F.lit(b)) for b, ps in ANSWER_BOUNDARIES]
    tests.append(F.when(has(both, *TENANT_PATTERNS), F.lit("BOUNDARY_007")))
    tests.append(F.when(has(response, *UNSUPPORTED_PATTERNS), F.lit("BOUNDARY_010")))
    return F.array_compact(F.array(*tests))


def governance_decision(
    df: DataFrame,
    prompt: str = "prompt",
    response: str = "response",
    sources: str = "sources",
    confidence: str = "confidence",
    truth_score: str = "truth_score",
    truth_rejected: str = "truth_rejected",
) -> DataFrame:
    """Tier, sufficiency, hallucination, citations, approval, masking and fallback of an answer.

    ``truth_score`` and ``truth_rejected`` come from checking the answer against its real
    evidence.
    """
    p, a, c = F.col(prompt), F.col(response), F.col(confidence)
    n = F.size(sources)
    out = df.withColumns(
        {
            "confidence_level": confidence_tier(c),
            "evidence_sufficient": (c >= TIER_MODERATE) & (n > 0),
            "hallucination_detected": hallucination_flag(a, n, c) | F.col(truth_rejected),
            "citations_valid": citation_check(a, F.col(sources))["valid"],
            "pending_action": high_impact_action(p, a),
            "pii_masked": mask_labels(a) != a,
            "policy_violations": policy_violations(p, a),
            "boundary_violations": boundary_violations(p, a),
        }
    )
    fallback = (
        ~F.col("evidence_sufficient")
        | F.col("hallucination_detected")
        | (F.size("boundary_violations") > 0)
    )
    explanation = F.concat_ws(
        "\n",
        F.format_string("Confidence: %s (%s)", fixed(c, 2), F.col("confidence_level")),
        F.format_string("Sources retrieved: %d", n),
        F.concat(F.lit("Evidence sufficient: "), F.col("evidence_sufficient").cast("string")),
        F.concat(
            F.lit("Hallucination check: "),
            F.when(F.col("hallucination_detected"), "FLAGGED").otherwise("PASS"),
        ),
        F.format_string("Truth Score: %s%%", fixed(F.col(truth_score) * 100, 0)),
    )
    return out.withColumns(
        {
            "requires_approval": F.col("pending_action").isNotNull(),
            "safe_fallback": fallback,
            "explanation": explanation,
        }
    )


# Answer given when evidence does not suffice.
GUARD_ANSWER = (
    "I could not find sufficient evidence in the indexed knowledge base "
    "to answer this confidently. Please provide more context, upload "
    "relevant documentation, or consult a senior analyst."
)
EVIDENCE_THRESHOLD = 0.5


def tier_answer(answer: Column, confidence: Column, sources: Column) -> Column:
    """The answer as shown: unchanged, with a caution, or replaced."""
    tier = confidence_tier(confidence)
    enough = (sources > 0) & (confidence >= EVIDENCE_THRESHOLD)
    caution = F.format_string(
        "\n\n> **Caution**: This response has moderate confidence (%s%%). "
        "Please verify with additional sources.\n",
        fixed(confidence * 100, 0),
    )
    return (
        F.when(~enough | (tier == "low"), F.lit(GUARD_ANSWER))
        .when(tier == "moderate", F.concat(answer, caution))
        .otherwise(answer)
    )


# Request types refused and allowed, and prompt patterns refused.
BLOCKED_REQUESTS = (
    "create_incident",
    "close_incident",
    "escalate_incident",
    "modify_severity",
    "modify_confidence",
    "detect_anomaly",
    "set_threat_score",
    "override_rule_engine",
    "override_isolation_forest",
    "override_threat_fusion",
    "override_risk_engine",
    "modify_detection_threshold",
    "execute_security_action",
    "block_ip",
    "isolate_endpoint",
    "disable_account",
)
ALLOWED_REQUESTS = (
    "anomaly_explanation",
    "incident_summarization",
    "mitre_description",
    "mitigation_recommendation",
    "analyst_question",
    "executive_report",
    "knowledge_search",
    "threat_intel_lookup",
    "playbook_guidance",
)
PROMPT_PATTERNS = (
    (r"\b(create|open|raise)\s+(an?\s+)?incident\b", "GR-001: Incident creation blocked"),
    (r"\b(close|resolve|dismiss)\s+(an?\s+)?incident\b", "GR-001: Incident closure blocked"),
    (
        r"\b(change|set|modify|update)\s+(the\s+)?severity\b",
        "GR-002: Severity modification blocked",
    ),
    (r"\b(change|set|adjust)\s+(the\s+)?confidence\b", "GR-002: Confidence modification blocked"),
    (
        r"\bis\s+this\s+(an?\s+)?anomaly\b",
        "GR-003: Detection decision blocked — use deterministic engines",
    ),
    (r"\bshould\s+(i|we)\s+(alert|escalate|block)\b", "GR-003: Detection decision blocked"),
    (r"\b(block|ban)\s+(this\s+)?ip\b", "GR-010: Autonomous action blocked"),
    (
        r"\bisolate\s+(this\s+)?(endpoint|host|machine)\b",
        "GR-010: Autonomous action blocked",
    ),
    (r"\bdisable\s+(this\s+)?(account|user)\b", "GR-010: Autonomous action blocked"),
)
STALE_MS = 30 * 60 * 1000


def boundary_check(request_type: Column, prompt: Column) -> Column:
    """Messages for a request type or prompt outside the advisory role."""
    kind = F.when(
        request_type.isin(*BLOCKED_REQUESTS),
        F.format_string("Request type '%s' is outside AI advisory boundaries.", request_type),
    ).when(
        ~request_type.isin(*ALLOWED_REQUESTS),
        F.format_string("Unknown request type '%s' — not in allowed list.", request_type),
    )
    return F.array_compact(
        F.array(kind, *[F.when(has(prompt, p), F.lit(m)) for p, m in PROMPT_PATTERNS])
    )


# Policies (id, name, rule, severity, action, tenants may switch it off).
POLICIES = (
    (
        "POL-003",
        "No Severity Modification",
        "AI cannot suggest changing incident severity",
        "HIGH",
        "BLOCK",
        False,
    ),
    (
        "POL-004",
        "No Confidence Modification",
        "AI cannot modify, inflate or deflate confidence scores",
        "HIGH",
        "BLOCK",
        False,
    ),
    (
        "POL-005",
        "No Incident Creation",
        "AI cannot create, close, or escalate incidents",
        "CRITICAL",
        "BLOCK_AND_AUDIT",
        False,
    ),
    (
        "POL-010",
        "No Autonomous Actions",
        "AI cannot initiate or recommend immediate autonomous security actions",
        "HIGH",
        "BLOCK",
        False,
    ),
    (
        "POL-013",
        "No Stale Evidence Reference",
        "AI cannot reference evidence older than 30 minutes without disclaimer",
        "HIGH",
        "BLOCK",
        True,
    ),
    (
        "POL-019",
        "Session Context Isolation",
        "Session context must not contain previous tenant data",
        "CRITICAL",
        "BLOCK_AND_AUDIT",
        False,
    ),
    (
        "POL-020",
        "Cost Budget Enforcement",
        "AI cost per tenant must not exceed monthly budget",
        "HIGH",
        "BLOCK",
        True,
    ),
)
# Policies that carry no check of the request itself.
SEVERITY_ORDER = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
BLOCKING = ("BLOCK", "BLOCK_AND_AUDIT")


def _policy_tests() -> dict[str, Column]:
    kind = F.col("request_type")
    modify = kind.isin("modify_severity", "modify_confidence")
    return {
        "POL-003": modify,
        "POL-004": modify,
        "POL-005": kind.isin("create_incident", "close_incident"),
        "POL-010": F.col("contains_autonomous_action"),
        "POL-013": F.col("evidence_age_ms") > STALE_MS,
        "POL-019": F.col("session_tenant_mismatch"),
        "POL-020": F.col("budget_exceeded"),
    }


def policy_registry_eval(
    requests: DataFrame, overrides: DataFrame | None = None, org: str = "org"
) -> DataFrame:
    """Violated policies of each request, whether it is allowed, and the worst severity.

    ``overrides`` (org, policy_id, enabled) switches off policies that permit it.
    """
    tests = _policy_tests()
    if overrides is None:
        off = F.array().cast("array<string>")
        rows = requests
    else:
        soft = [p[0] for p in POLICIES if p[5]]
        switched = (
            overrides.filter(~F.col("enabled") & F.col("policy_id").isin(*soft))
            .groupBy(org)
            .agg(F.collect_set("policy_id").alias("_off"))
        )
        rows = requests.join(switched, org, "left")
        off = F.coalesce("_off", F.array().cast("array<string>"))
    hits = F.array(
        *[
            F.when(
                F.coalesce(tests[pid], F.lit(False)) & ~F.array_contains(off, pid),
                F.struct(
                    F.lit(pid).alias("policy_id"),
                    F.lit(severity).alias("severity"),
                    F.lit(action).alias("action"),
                    F.lit(f"Policy {pid} ({name}): {rule}").alias("message"),
                ),
            )
            for pid, name, rule, severity, action, _ in POLICIES
        ]
    )
    rows = rows.withColumn("violated", F.array_compact(hits)).drop("_off")
    blocked = F.exists("violated", lambda v: v["action"].isin(*BLOCKING))
    worst = F.coalesce(
        *[
            F.when(F.array_contains(F.transform("violated", lambda v: v["severity"]), s), F.lit(s))
            for s in SEVERITY_ORDER
        ]
    )
    return rows.withColumns({"policy_allowed": ~blocked, "highest_severity": worst})


def guardrail_screen(
    requests: DataFrame, overrides: DataFrame | None = None, org: str = "org"
) -> DataFrame:
    """Boundary and policy violations of each request, its risk and whether it may pass.

    Requests have request_type, prompt, evidence_age_ms, org and session_org.
    """
    context = requests.withColumns(
        {
            "contains_autonomous_action": F.col("request_type").isin(*BLOCKED_REQUESTS),
            "session_tenant_mismatch": F.coalesce(F.col("session_org") != F.col(org), F.lit(False)),
            "budget_exceeded": F.lit(False),
        }
    )
    out = policy_registry_eval(context, overrides, org).withColumn(
        "violations",
        F.concat(
            boundary_check(F.col("request_type"), F.col("prompt")),
            F.transform("violated", lambda v: v["message"]),
        ),
    )
    n = F.size("violations")
    risk = F.least(
        F.when(F.col("contains_autonomous_action"), 0.5).otherwise(0.0)
        + F.least(n * 0.2, F.lit(0.4))
        + F.when(F.col("evidence_age_ms") > STALE_MS, 0.1).otherwise(0.0),
        F.lit(1.0),
    )
    return out.withColumns(
        {"allowed": n == 0, "risk_score": risk, "reason": F.get("violations", F.lit(0))}
    )


# Sources documents may be trusted from, and patterns that quarantine them.
APPROVED_SOURCES = (
    "mitre_attack",
    "nist_nvd",
    "threat_intel_verified",
    "security_playbooks_approved",
    "internal_ops_verified",
)
CONTENT_PATTERNS = (
    (r"\b\d{3}-\d{2}-\d{4}\b", False),
    (r"(\b(sk|pk|ak|key)[-_]?[A-Za-z0-9]{16,}\b)", True),
)
CONTENT_MESSAGE = "PII or secrets detected in document content."
SIGNATURE_MESSAGE = "Restricted document missing cryptographic signature."


def scan_documents(df: DataFrame, text: str = "text") -> DataFrame:
    """Trust level, violations and action of documents by source, class and content.

    Documents have source, classification, verified and signature.
    """
    source = F.lower("source")
    approved = source.rlike("|".join(APPROVED_SOURCES))
    kind = F.col("classification")
    trust = (
        F.when(approved & F.col("verified"), "CRITICAL")
        .when(kind == "public", "MEDIUM")
        .when(kind == "internal", "HIGH")
        .when(kind == "restricted", "MEDIUM")
        .otherwise("LOW")
    )
    unsigned = (kind == "restricted") & (F.coalesce("signature", F.lit("")) == "")
    found = [
        F.when(has(F.col(text), p, ignore_case=ic), F.lit(CONTENT_MESSAGE))
        for p, ic in CONTENT_PATTERNS
    ]
    found.append(F.when(unsigned, F.lit(SIGNATURE_MESSAGE)))
    out = df.withColumns(
        {"trust_level": trust, "violations": F.array_compact(F.array(*found))}
    )
    action = (
        F.when(F.size("violations") > 0, "QUARANTINE")
        .when(F.col("trust_level") == "LOW", "LOG_ONLY")
        .otherwise("INDEX")
    )
    return out.withColumn("suggested_action", action)


# Runbooks (id, title, description, technique, severities, tags).
RUNBOOKS = (
    (
        "rb_brute_force",
        "Brute Force Attack Response",
        "Standard playbook for responding to brute force authentication attacks.",
        "T1110",
        ("HIGH", "CRITICAL"),
        ("authentication", "brute_force", "login"),
    ),
    (
        "rb_ddos",
        "DDoS Mitigation Playbook",
        "Response procedure for Distributed Denial of Service attacks.",
        "T1498",
        ("HIGH", "CRITICAL"),
        ("ddos", "traffic_spike", "denial_of_service"),
    ),
    (
        "rb_exfiltration",
        "Data Exfiltration Response",
        "Investigation and containment of suspected data exfiltration.",
        "T1041",
        ("HIGH", "CRITICAL"),
        ("exfiltration", "data_transfer", "outbound"),
    ),
    (
        "rb_insider",
        "Insider Threat Investigation",
        "Procedure for investigating potential insider threat activity.",
        "T1078",
        ("MEDIUM", "HIGH", "CRITICAL"),
        ("insider", "privileged", "unauthorized_access"),
    ),
    (
        "rb_service_failure",
        "Service Failure Recovery",
        "Standard recovery procedure for critical service failures.",
        None,
        ("MEDIUM", "HIGH"),
        ("service_failure", "heartbeat", "availability"),
    ),
)
RUNBOOKS_SHOWN = 3


def _known_parts(runbooks) -> list[str]:
    """Every word of four letters or more that titles or descriptions can contain."""
    tokens = {t for rb in runbooks for text in rb[1:3] for t in text.lower().split()}
    return sorted(
        {t[i:j] for t in tokens for i in range(len(t)) for j in range(i + 4, len(t) + 1)}
    )


def suggest_runbooks(
    df: DataFrame, severity: str, context: str, technique: str | None = None, runbooks=RUNBOOKS
) -> DataFrame:
    """Up to three best runbooks per row, one row each, best first.

    Runbooks are few literals, so all are scored inside the row and no join is needed.
    """
    # A word that is no part of any runbook text scores nothing: one look-up drops it.
    parts = _known_parts(runbooks)
    rows = df.withColumn("_context", F.lower(context)).withColumn(
        "_words", F.filter(F.split("_context", r"\s+"), lambda w: w.isin(*parts))
    )

    def hits(text: str) -> Column:
        return F.size(F.filter("_words", lambda w: F.contains(F.lit(text.lower()), w)))

    scored = []
    for i, (rid, title, description, tech, levels, tags) in enumerate(runbooks):
        score = F.when(F.col(severity).isin(*levels), 2).otherwise(0)
        if technique is not None and tech is not None:
            same = F.coalesce(F.col(technique) == tech, F.lit(False))
            score = score + F.when(same, 5).otherwise(0)
        for tag in tags:
            score = score + F.when(F.contains("_context", F.lit(tag)), 3).otherwise(0)
        score = score + hits(title) + hits(description)
        scored.append(
            F.struct(
                (-score).alias("order"), F.lit(i).alias("i"), F.lit(rid).alias("runbook_id"),
                score.alias("score"),
            )
        )
    rows = rows.withColumn("_scored", F.array(*scored))
    best = F.slice(F.array_sort(F.filter("_scored", lambda s: s["score"] > 0)), 1, RUNBOOKS_SHOWN)
    out = rows.select(*df.columns, F.posexplode(best).alias("rank", "_r"))
    return out.select(
        *df.columns, (F.col("rank") + 1).alias("rank"), "_r.runbook_id", "_r.score"
    )

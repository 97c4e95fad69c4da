"""Fixed values the results depend on: word lists, rule tables, patterns, labels.

Operators take these as parameters; the constants here are the defaults.
"""

from __future__ import annotations

# --- fixed values: direction vocabulary, flag -> (up, down) ------------------
DIRECTIONS = {
    "inflation_12m_direction": ("accelerating", "decelerating"),
    "usd_brl_direction": ("depreciating_brl", "appreciating_brl"),
    "credit_yoy_direction": ("expanding", "contracting"),
    "pix_count_yoy_direction": ("expanding", "contracting"),
}
DEFAULT_DIRECTION = ("rising", "falling")

# --- fixed values: reporting table of an operating release --------------------
SUMMARY = (
    r"(?i)The following table summarizes certain key performance metrics for the (.+?) periods? ended "
    r"(March|June|September|December)\s+(\d{1,2}),\s+(\d{4})\s+and\s+(\d{4})"
)
BLOCK_START = "fintech monthly active users"
BLOCK_END = "capital expenditures"
NUMBER = r"\$?\s*(\(?-?\d[\d,]*(?:\.\d+)?\)?)\s*(%?)"
# (metric, label, unit, scale factor), in table order
KPI_LABELS = (
    ("fintech_mau", "Fintech monthly active users", "users", 1_000_000),
    ("unique_active_buyers", "Unique active buyers", "users", 1_000_000),
    ("gmv", "Gross merchandise volume", "USD", 1_000_000),
    ("items_sold", "Number of items sold", "items", 1_000_000),
    ("tpv", "Total payment volume", "USD", 1_000_000),
    ("acquiring_tpv", "Acquiring total payment volume", "USD", 1_000_000),
    ("payment_transactions", "Total payment transactions", "transactions", 1_000_000),
    ("nimal", "NIMAL", "percent", 1),
)
SNAPSHOT_METRICS = ("fintech_mau",)

# --- fixed values: definition versions of operating metrics ---------------------
# (metrics, version, period ends before, period ends on or after, period starts before, marker text); first match wins
RECAST_MARKER = "have been recast to exclude peer-to-peer transactions"
DEFINITION_RULES = (
    (("unique_active_buyers", "gmv", "items_sold"), "v1_marketplace_only", "2025-06-30", None, None, None),
    (("unique_active_buyers", "gmv", "items_sold"), "v2_food_delivery_transition_2025", None, "2025-06-30", "2025-04-01", None),
    (("unique_active_buyers", "gmv", "items_sold"), "v2_food_delivery", None, None, None, None),
    (("fintech_mau",), "v2_active_policy_and_current_loan", None, "2026-03-31", None, None),
    (("fintech_mau",), "v1_transaction_action", None, None, None, None),
    (("tpv", "payment_transactions"), "v2_excludes_p2p", None, "2024-01-01", None, None),
    (("tpv", "payment_transactions"), "v2_recast_excludes_p2p", None, "2023-01-01", None, RECAST_MARKER),
    (("tpv", "payment_transactions"), "v1_includes_p2p", None, None, None, None),
)
DEFAULT_DEFINITION = "v1"
COMPARISON_FAMILIES = {
    metric: {"v2_excludes_p2p": "excludes_p2p", "v2_recast_excludes_p2p": "excludes_p2p"} for metric in ("tpv", "payment_transactions")
}

# --- fixed values: qualified values in release text -----------------------------
# Text without its anchor (any case) cannot match any pattern of the metric.
QUALIFIED_ANCHORS = {"aum": "aum", "credit_portfolio": "credit portfolio", "npl_15_90_total": "15-90 day npl"}
# metric -> (patterns as (regex, value group, approximation group or 0), factor, unit, scope, definition)
QUALIFIED = {
    "aum": ((
        (r"(?i)AUM has grown from \$[\d.]+bn to (almost\s+)?\$([\d.]+)bn", 2, 1),
        (r"(?i)AUM.{0,260}?(?:reached|(?:grew|doubling)[^$]{0,120}?to)\s+(almost\s+)?\$([\d.]+)bn", 2, 1),
    ), 1_000_000_000, "USD", "total", "v1"),
    "credit_portfolio": ((
        (r"(?i)(?:total\s+)?credit portfolio.{0,320}?\$([\d.]+)bn", 1, 0),
    ), 1_000_000_000, "USD", "total_portfolio", "v1_total_credit_portfolio"),
    "npl_15_90_total": ((
        (r"(?i)15-90 day NPL of (\d+(?:\.\d+)?)% for the portfolio as a whole", 1, 0),
        (r"(?i)15-90 day NPL was (\d+(?:\.\d+)?)% for the portfolio as a whole", 1, 0),
        (r"(?i)Our 15-90 day NPL ratio improved to (\d+(?:\.\d+)?)%", 1, 0),
        (r"(?i)The 15-90 day NPL remained stable at (\d+(?:\.\d+)?)%", 1, 0),
        (r"(?i)with the 15-90 day NPL broadly stable QoQ at (\d+(?:\.\d+)?)%", 1, 0),
        (r"(?i)with the 15-90 day NPL of (\d+(?:\.\d+)?)% broadly stable YoY", 1, 0),
    ), 1, "percent", "total_portfolio", "v1_15_90_total_portfolio"),
}
LOWER_BOUND_WORDS = ("surpassed", "exceeds", "more than")
LOWER_BOUND_METRICS = ("credit_portfolio",)
LOWER_BOUND_REACH = 70
EXCERPT_BEFORE = 250
EXCERPT_AFTER = 350

# --- fixed values: narrative topics (a topic named after a product is left to the caller) ---
TOPICS = {
    "ecosystemic_users": ("Ecosystem", r"(?i)\becosystemic users?\b"),
    "advertising": ("Ads", r"(?i)\badvertising\b|\bAds revenue\b|\bdigital advertising market\b"),
    "fulfillment": ("Logistics", r"(?i)\bfulfillment\b"),
}
SIGNAL = r"(?i)\d|growth|grow|grew|growing|volume|share|revenue|subscriber|users?|GMV|TPV|shipping|delivery|penetration|cost|market"
STATEMENTS_PER_TOPIC = 3

# --- fixed values: claim kinds; exactly one family must match --------------------
CLAIM_KINDS = {
    "growth": r"(?i)\b(?:grew|growth|growing|grow|increased|increase|expanded|expansion)\b"
              r"|\bup\s+(?:by\s+\d+(?:\.\d+)?(?:\s*(?:%|ppts?))?|\d+(?:\.\d+)?\s*(?:%|ppts?))(?!\w)",
    "share": r"(?i)\b(?:share|penetration|ppts)\b|%\s+of\b",
    "engagement": r"(?i)\b(?:ecosystemic users?|active behavior|daily active|bought|purchased|categories bought|used together|use together|"
                  r"frequency of use|cross[- ]use)\b",
    "operational": r"(?i)\b(?:fulfillment|delivery|shipping|shipments?|cost|operational volume)\b",
}

# --- fixed values: wording that claims may not use, one guard per classification ---
# Interpretations, quadrants and product rows: a pattern. Dimensions: parts of the lower-cased text.
INTERPRETATION_WORDING = (
    r"(?iuU)\b(caused|causes|because of|led to|drives?|explains?|proves?|recommend(?:ation)?|should build|must build|feature|solution|causar|causou|"
    r"por causa de|levou a|explica|prova|recomenda(?:ção)?|deveria construir|deve construir|funcionalidade|solução|oportunidade|ameaça)\b"
)
DIMENSION_WORDING = (
    "recommendation", "opportunity", "threat", "strength", "weakness", "should build", "must build", "feature", "solution",
    "caused", "causes", "because of", "led to", "explains", "proves", "causal",
    "recomendação", "oportunidade", "ameaça", "força", "fraqueza", "deveria construir", "solução", "causou", "causa", "explica", "prova",
)
QUADRANT_WORDING = (
    r"(?iuU)\b(caused|causes|because of|led to|drives?|explains?|proves?|recommend(?:ation)?|"
    r"should build|must build|feature|solution|product opportunity|product problem|"
    r"causou|causa|por causa de|levou a|explica|prova|recomenda(?:ção)?|"
    r"deveria construir|deve construir|funcionalidade|solução|problema de produto|"
    r"oportunidade de produto)\b"
)
PRODUCT_WORDING = (
    r"(?iuU)\b(caused|causes|because of|led to|drives?|proves?|guarantees?|will increase|will improve|"
    r"recommend(?:ation)?|should build|must build|feature|solution|roadmap|prioriti[sz]e|"
    r"launch|cashback|rewards?|loyalty(?: program)?|users?\s+(?:want|need)|customers?\s+(?:want|need)|"
    r"causou|causa|por causa de|levou a|explica|prova|garante|vai aumentar|vai melhorar|"
    r"recomenda(?:ção)?|deveria construir|deve construir|funcionalidade|solução|roteiro|"
    r"priorize|lançar|recompensa|programa de fidelidade|usuários?\s+(?:querem|precisam)|"
    r"clientes?\s+(?:querem|precisam)\b)"
)
UNCERTAIN_WORDS = ("may", "might", "could", "require validation", "requires validation", "worth investigating")
QUESTION_STARTS = ("how", "what", "which", "where", "when", "to what extent")

# --- fixed values: evidence vocabulary ------------------------------------------
EVIDENCE_TYPES = ("FACT", "OBSERVATION", "INTERPRETATION")
EVIDENCE_PRIORITY = {"FACT": 1, "OBSERVATION": 2, "INTERPRETATION": 3}
EVIDENCE_SCOPE = {"gmv": ("Commerce", "USD"), "unique_active_buyers": ("Commerce", "users"), "fintech_mau": ("Fintech", "users"), "tpv": ("Fintech", "USD")}
NO_BASELINE = "no comparable positive prior-year baseline or eligible period"
OUT_OF_SCOPE = "outside metric scope"

# --- fixed values: single-source interpretations, metric -> (predicate, text, kind) ---
INTERPRETATIONS = {
    "net_revenues_financial_income_yoy_growth": ("positive_value", "Revenue increased versus the comparable period, indicating expansion in reported revenue.", "reported_revenue_expansion"),
    "revenue_yoy_growth": ("positive_value", "Revenue increased versus the comparable period, indicating expansion in reported revenue.", "reported_revenue_expansion"),
    "gmv_yoy_growth": ("positive_value", "GMV increased versus the comparable period, indicating expansion in reported commerce volume.", "reported_gmv_expansion"),
    "fintech_mau_yoy_growth": ("positive_value", "Fintech MAU increased versus the comparable period, indicating a larger reported active fintech user base.", "reported_fintech_user_base_expansion"),
    "pix_transactions_count_yoy_growth": ("growth_claim", "Pix transaction volume increased versus the same month of the prior year, indicating greater reported Pix usage.", "reported_pix_usage_increase"),
    "selic_target_change_pp": ("decline_claim", "The Selic target declined versus the previous observation.", "reported_selic_decline"),
}
GROWTH_CLAIMS = ("yoy_growth", "increase")
DECLINE_CLAIMS = ("decrease",)
JOINT_METRICS = ("fintech_mau_yoy_growth", "tpv_yoy_growth")
JOINT_TEXT = "Fintech active users and TPV both increased in the comparable periods represented by the selected evidence."

# --- fixed values: six-dimension classification ----------------------------------
ECONOMIC_METRICS = (
    "selic_target_annual", "selic_effective_annual_252", "selic_target_change_pp", "ipca_monthly_change", "ipca_12m_change", "ipca_12m_change_pp",
    "usd_brl_sell_rate", "usd_brl_month_end", "usd_brl_monthly_change_pct", "household_free_credit_balance", "household_free_credit_balance_yoy_growth",
    "household_free_credit_npl_90d_rate", "household_free_credit_npl_90d_yoy_change_pp", "ibc_br_activity_sa_index", "ibc_br_activity_mom_change_pct",
    "unemployment_rate_rolling_3m", "unemployment_rate_change_pp", "retail_sales_volume_mom_sa", "pix_transactions_count_monthly",
    "pix_transactions_value_monthly", "pix_transactions_count_yoy_growth", "pix_transactions_value_yoy_growth",
)
SOCIAL_METRICS = {"fintech_mau": "Fintech", "fintech_mau_yoy_growth": "Fintech", "unique_active_buyers": "Commerce", "unique_active_buyers_yoy_growth": "Commerce"}
SOCIAL_CLAIMS = ("level", "growth", "increase", "yoy_growth", "yoy_decline", "other")
ADOPTION_METRICS = ("pix_transactions_count_monthly", "pix_transactions_count_yoy_growth")
ADOPTION_CLAIMS = ("technology_adoption", "digital_payment_adoption", "digital_infrastructure")
STRUCTURED_CLAIMS = {
    "POLITICAL": ("public_policy", "government_decision"),
    "LEGAL": ("regulatory_requirement", "compliance_obligation"),
    "ENVIRONMENTAL": ("environmental_measurement", "environmental_impact"),
}
RATIONALES = {
    "ECONOMIC": "Classified as ECONOMIC because the source metric is an official macroeconomic or payment activity indicator.",
    "SOCIAL": "Classified as SOCIAL because the source metric reports an explicitly identified user base or buyer activity.",
    "TECHNOLOGICAL": "Classified as TECHNOLOGICAL because the source evidence explicitly tags technology or digital infrastructure adoption.",
    "POLITICAL": "Classified as POLITICAL because the source evidence explicitly identifies a public policy or government decision.",
    "LEGAL": "Classified as LEGAL because the source evidence explicitly identifies a regulatory or compliance obligation.",
    "ENVIRONMENTAL": "Classified as ENVIRONMENTAL because the source evidence explicitly identifies an environmental measure.",
}

# --- fixed values: four-quadrant classification ----------------------------------
INTERNAL_DOMAINS = ("Financial", "Commerce", "Fintech", "Ecosystem", "Ads", "Logistics")
INTERNAL_GROWTH = {
    "revenue_yoy_growth": ("Financial", "reported revenue"),
    "net_revenues_financial_income_yoy_growth": ("Financial", "reported revenue and financial income"),
    "gmv_yoy_growth": ("Commerce", "reported GMV"),
    "unique_active_buyers_yoy_growth": ("Commerce", "reported active buyers"),
    "fintech_mau_yoy_growth": ("Fintech", "reported active fintech users"),
    "tpv_yoy_growth": ("Fintech", "reported TPV"),
}
STRENGTH_CLAIMS = ("growth", "increase", "yoy_growth")
WEAKNESS_CLAIMS = ("decrease", "yoy_decline")
INTERNAL_RATIONALE = "Classified from an INTERNAL company metric in the explicit metric/domain/direction allowlist."
# (metric, dimension, category, claim kinds, context note, assessment, rationale); the value must be positive
EXTERNAL_RULES = (
    ("pix_transactions_count_yoy_growth", "TECHNOLOGICAL", "OPPORTUNITY",
     ("growth", "increase", "yoy_growth", "technology_adoption", "digital_payment_adoption"), "national_digital_payment_context;not_company_performance",
     "The reported expansion in national Pix transaction volume is classified under the explicit external digital-payments rule.",
     "Classified from a TECHNOLOGICAL PESTEL item explicitly linked to reported Pix transaction growth."),
    ("selic_target_change_pp", "ECONOMIC", "THREAT", ("increase", "rising"), "external_financial_environment;not_company_performance",
     "The reported increase in the Selic target is classified as a change in the external financial environment under the explicit rule.",
     "Classified from an ECONOMIC PESTEL item explicitly linked to a rising Selic target."),
)
# Definitions of these two delinquency metrics may never be combined.
INCOMPATIBLE_METRICS = ("household_free_credit_npl_90d_rate", "npl_15_90_total")
DEFINITION_TOKEN = r"(?i)\b(definition_version|definition|scope|cohort|population)\s*=\s*([^;|,]+)"

# --- fixed values: cross-domain hypotheses ---------------------------------------
COMMERCE_METRICS = ("unique_active_buyers_yoy_growth", "gmv_yoy_growth")
FINTECH_METRICS = ("fintech_mau_yoy_growth", "tpv_yoy_growth")
HYPOTHESIS = (
    "Reported aggregate Commerce and Fintech activity may correspond to distinct cross-domain ecosystem engagement patterns; "
    "the available aggregates do not establish user-level overlap, so the relationship requires user-level validation."
)
QUESTION = (
    "How do engagement patterns differ among users active in Commerce, in Fintech, and in both domains, if user-level overlap is present?"
)

HYPOTHESIS_RATIONALE = (
    "Generated from temporally and definition-compatible Commerce and Fintech Evidence. Aggregate metrics do not identify the same users across domains; "
    "user-level validation is required before making claims about cross-domain engagement."
)
QUESTION_RATIONALE = (
    "This open question is intended to validate or qualify the linked hypothesis without assuming that cross-domain overlap exists or that a Product problem is present."
)
PRODUCT_THEME, PRODUCT_DOMAIN, PRODUCT_SCOPE = "ECOSYSTEM_ENGAGEMENT", "Ecosystem", "AGGREGATE"
PRODUCT_CONTEXT = "aggregate_metrics_only;no_user_level_overlap_inference"

# --- fixed values: claim texts of series observations -----------------------------
FACT_LABELS = {
    "selic_target_annual": "Meta Selic",
    "selic_effective_annual_252": "Selic efetiva anualizada em base 252",
    "ipca_monthly_change": "IPCA mensal",
    "ipca_12m_change": "IPCA acumulado em 12 meses",
    "usd_brl_sell_rate": "Cotação diária de venda USD/BRL",
    "household_free_credit_balance": "Saldo de crédito livre para pessoas físicas",
    "household_free_credit_npl_90d_rate": "Inadimplência BCB de crédito livre PF acima de 90 dias",
    "ibc_br_activity_sa_index": "Índice de atividade econômica IBC-Br com ajuste sazonal",
    "unemployment_rate_rolling_3m": "Taxa de desocupação do trimestre móvel de três meses",
    "retail_sales_volume_mom_sa": "Variação mensal dessazonalizada do volume de vendas no varejo",
    "pix_transactions_count_monthly": "Quantidade mensal de transações Pix",
    "pix_transactions_value_monthly": "Valor mensal de transações Pix",
}
UNIT_SUFFIXES = {
    "percent": "%", "percent_per_year": "% ao ano", "million_brl": " milhões de BRL", "brl_per_usd": " BRL por USD",
    "transactions": " transações", "brl": " BRL",
}
# metric -> (vocabulary, text with {verb}, {number}, {month})
CHANGE_TEXTS = {
    "selic_target_change_pp": ("change", "A Meta Selic {verb} {number} p.p. em relação à observação anterior em {month}."),
    "ipca_12m_change_pp": ("inflation", "O IPCA acumulado em 12 meses {verb} {number} p.p. ante o mês anterior em {month}."),
    "usd_brl_monthly_change_pct": ("change", "A cotação USD/BRL {verb} {number}% ante o mês anterior em {month}."),
    "household_free_credit_balance_yoy_growth": ("growth", "O saldo de crédito livre PF {verb} {number}% ante o mesmo mês do ano anterior em {month}."),
    "household_free_credit_npl_90d_yoy_change_pp": ("change", "A inadimplência BCB de crédito livre PF acima de 90 dias {verb} {number} p.p. ante o mesmo mês do ano anterior em {month}."),
    "ibc_br_activity_mom_change_pct": ("change", "A atividade econômica medida pelo IBC-Br com ajuste sazonal {verb} {number}% ante o mês anterior em {month}."),
    "unemployment_rate_change_pp": ("change", "A taxa de desocupação do trimestre móvel de três meses {verb} {number} p.p. ante a publicação anterior em {month}."),
    "pix_transactions_count_yoy_growth": ("growth", "A quantidade mensal de transações Pix {verb} {number}% ante o mesmo mês do ano anterior em {month}."),
    "pix_transactions_value_yoy_growth": ("growth", "O valor mensal de transações Pix {verb} {number}% ante o mesmo mês do ano anterior em {month}."),
}
# vocabulary -> ((kind, verb) for positive, (kind, verb) for negative values)
CHANGE_WORDS = {
    "change": (("increase", "aumentou"), ("decrease", "diminuiu")),
    "inflation": (("acceleration", "acelerou"), ("deceleration", "desacelerou")),
    "growth": (("yoy_growth", "aumentou"), ("yoy_decline", "diminuiu")),
}
UNCHANGED = ("unchanged", "permaneceu sem variação")

"""Fixed values.

Everything in this module is a fixed value that must equal the reference
application's for identical results: metric name patterns, benchmark and
modifier tables, regulation texts, templates, catalogues, keyword lists,
regular expressions and replacement maps. They are kept as plain data, in
their natural order, and turned into small dimension DataFrames by
``verdant.operators.dims``.
"""

# ---------------------------------------------------------------------------
# Metric -> column-name patterns, in order of preference.
# ---------------------------------------------------------------------------
COLUMN_PATTERNS = {
    "company": ["company", "firm", "organisation", "organization", "entity", "name"],
    "industry": ["industry", "sector", "segment"],
    "country": ["country", "region", "location", "nation", "geography"],
    "year": ["year", "fiscal_year", "fy", "period"],
    "employees": ["employee", "headcount", "staff", "workforce", "fte"],
    "revenue": ["revenue", "turnover", "sales", "income"],
    "esg_budget": ["esg_budget", "esg_spend", "sustainability_budget", "green_spend"],
    "carbon_emissions": ["carbon", "emission", "co2", "ghg", "tco2", "greenhouse"],
    "energy": ["energy", "electricity", "power_consumption", "mwh", "kwh"],
    "renewable_energy": ["renewable", "clean_energy", "green_energy", "solar", "wind"],
    "water": ["water"],
    "waste_total": ["waste_generated", "waste_total", "waste_produced", "total_waste"],
    "waste_recycled": ["waste_recycl", "recycl", "recycled_waste"],
    "gender_diversity": ["gender_divers", "female_pct", "women_pct", "diversity", "gender_ratio"],
    "employee_turnover": ["turnover_pct", "attrition", "employee_turnover"],
    "training": ["training_hour", "learning_hour", "training"],
    "board_independence": ["board_independ", "independent_director"],
    "safety": ["safety_incident", "injury", "accident", "ltir", "trir"],
    "community_investment": ["community_invest", "social_invest", "philanthrop", "donation", "charitable"],
    "scope1": ["scope1", "scope_1", "direct_emissions"],
    "scope2": ["scope2", "scope_2", "indirect_emissions"],
    "scope3": ["scope3", "scope_3", "value_chain"],
}

# Trend direction of each metric.
LOWER_IS_BETTER = ["carbon_emissions", "water", "waste_total", "employee_turnover", "safety",
                   "scope1", "scope2", "scope3", "energy"]
HIGHER_IS_BETTER = ["renewable_energy", "waste_recycled", "gender_diversity", "training",
                    "board_independence", "community_investment", "esg_budget", "revenue", "employees"]

# Metrics shown in the peer table, in order.
PEER_METRICS = ["employees", "carbon_emissions", "renewable_energy", "gender_diversity",
                "board_independence", "waste_recycled"]

# Industry benchmarks. Columns: industry, esg_score_avg,
# esg_score_top_quartile, carbon_intensity_avg, renewable_energy_pct,
# gender_diversity_pct, board_independence_pct, employee_turnover_pct,
# waste_recycling_pct, esg_disclosure_pct. Last row: the default.
BENCHMARK_COLUMNS = ["esg_score_avg", "esg_score_top_quartile", "carbon_intensity_avg",
                     "renewable_energy_pct", "gender_diversity_pct", "board_independence_pct",
                     "employee_turnover_pct", "waste_recycling_pct", "esg_disclosure_pct"]
INDUSTRY_BENCHMARKS = [
    ("Technology", 62, 78, 45, 55, 32, 75, 18, 60, 72),
    ("Finance", 58, 74, 12, 42, 38, 80, 15, 45, 78),
    ("Financial Services", 58, 74, 12, 42, 38, 80, 15, 45, 78),
    ("Manufacturing", 48, 65, 220, 28, 22, 65, 12, 55, 58),
    ("Energy", 42, 60, 850, 22, 20, 70, 10, 40, 65),
    ("Oil And Gas", 38, 55, 1100, 15, 18, 68, 10, 35, 60),
    ("Healthcare", 55, 72, 60, 35, 45, 72, 20, 50, 68),
    ("Retail", 50, 68, 35, 40, 42, 68, 25, 48, 60),
    ("Agriculture", 44, 62, 300, 25, 28, 60, 22, 35, 50),
    ("Construction", 42, 58, 180, 20, 18, 62, 20, 42, 52),
    ("Transportation", 46, 63, 400, 18, 25, 65, 16, 38, 56),
    ("Pharmaceuticals", 57, 73, 55, 38, 44, 74, 14, 55, 70),
]
DEFAULT_BENCHMARK = (52, 70, 100, 35, 30, 70, 16, 50, 62)

# Industry modifiers (lower-case industry, e, s, g).
INDUSTRY_MODIFIERS = [
    ("technology", 5, 3, 8),
    ("finance", -3, 2, 10),
    ("financial services", -3, 2, 10),
    ("manufacturing", -8, -2, 3),
    ("energy", -10, 0, 5),
    ("oil and gas", -15, -2, 4),
    ("healthcare", 0, 8, 5),
    ("pharmaceuticals", 2, 6, 6),
    ("retail", -2, 5, 0),
    ("agriculture", -5, 2, -2),
    ("construction", -6, -3, 0),
    ("transportation", -7, 0, 2),
    ("utilities", -5, 1, 4),
    ("real estate", -3, 1, 2),
    ("hospitality", -1, 4, 0),
    ("mining", -12, -4, 2),
    ("education", 2, 6, 3),
    ("telecommunications", 3, 2, 5),
    ("consumer goods", -1, 3, 1),
]

# Regulation by country: (country, frameworks, key_deadlines,
# penalties, regulator). Country None is the default row.
REGULATIONS = [
    ("United Kingdom",
     ["UK Sustainability Disclosure Standards (SDS)", "TCFD (mandatory for large UK firms)",
      "Streamlined Energy and Carbon Reporting (SECR)", "UK Green Taxonomy (in development)"],
     "ISSB-aligned UK SDS expected to apply from 2026-2027 fiscal years.",
     "Non-compliance with SECR can result in fines up to GBP 5,000 and director liability.",
     "Financial Conduct Authority (FCA) & Department for Business and Trade"),
    ("United States",
     ["SEC Climate Disclosure Rule (stayed pending litigation)", "California SB 253/261",
      "EPA GHG Reporting Program", "Voluntary: SASB / GRI / TCFD"],
     "California SB 253 requires Scope 1 & 2 reporting from 2026, Scope 3 from 2027.",
     "SEC violations carry civil penalties; California laws include administrative penalties.",
     "SEC, EPA, California Air Resources Board"),
    ("Germany",
     ["EU CSRD (Corporate Sustainability Reporting Directive)", "EU Taxonomy Regulation",
      "German Supply Chain Due Diligence Act (LkSG)", "SFDR"],
     "CSRD applies to large companies from FY2024, listed SMEs from FY2026.",
     "LkSG fines up to 2% of average annual global turnover.",
     "BaFin, BAFA"),
    ("France",
     ["EU CSRD", "EU Taxonomy", "French Duty of Vigilance Law", "SFDR", "Article 29 Energy-Climate Law"],
     "CSRD phased in from FY2024. Duty of Vigilance applies to companies with 5,000+ employees.",
     "Duty of Vigilance: civil liability for failure to prevent harm in supply chain.",
     "AMF"),
    ("Japan",
     ["SSBJ (ISSB-aligned)", "TCFD (voluntary, high adoption)", "TSE Corporate Governance Code"],
     "SSBJ standards expected mandatory for prime-listed companies from FY2027.",
     "TSE follows comply-or-explain approach.",
     "FSA, Tokyo Stock Exchange"),
    ("China",
     ["Chinese Sustainability Disclosure Standards (ISSB-aligned)", "Mandatory ESG disclosure (CSRC)",
      "National ETS"],
     "Mandatory ESG disclosure for all A-share listed companies phased in from 2026.",
     "ETS non-compliance penalties under national carbon trading regulations.",
     "CSRC, Ministry of Ecology and Environment"),
    ("India",
     ["BRSR (Business Responsibility and Sustainability Reporting)", "SEBI ESG framework",
      "Green Credit Programme"],
     "BRSR mandatory for top 1000 listed companies. BRSR Core assurance from FY2023-24.",
     "Non-filing can result in SEBI enforcement actions and listing restrictions.",
     "SEBI"),
    ("Australia",
     ["AASB Sustainability Reporting Standards (ISSB-aligned)", "NGER", "Modern Slavery Act"],
     "Mandatory climate disclosure for Group 1 entities from 1 Jan 2025, Group 2 from 2026.",
     "NGER penalties up to AUD 22,200 per day for non-reporting.",
     "ASIC, Clean Energy Regulator"),
    ("Singapore",
     ["SGX mandatory climate reporting (TCFD-based)", "Singapore Green Plan 2030", "MAS Guidelines"],
     "SGX mandatory climate reporting for all listed issuers from FY2025.",
     "SGX non-compliance can result in queries, reprimands, or suspension.",
     "SGX RegCo, MAS"),
    ("Canada",
     ["CSA climate disclosure rules (proposed)", "Federal GHGRP", "Modern Slavery Act (Bill S-211)"],
     "Bill S-211 reporting obligations began January 2024.",
     "GHGRP non-reporting subject to federal environmental penalties.",
     "CSA, Environment and Climate Change Canada"),
    ("Brazil",
     ["CVM Resolution 193 (ISSB-aligned, voluntary until 2026)", "Brazilian Taxonomy for Sustainable Finance"],
     "CVM sustainability reporting becomes mandatory from FY2026.",
     "CVM enforcement for listed companies; fines for non-compliance.",
     "CVM, Central Bank of Brazil"),
    ("South Korea",
     ["K-ESG Guidelines", "Korean Sustainability Disclosure Standards", "K-Taxonomy"],
     "Mandatory ESG disclosure for KOSPI-listed companies (assets > KRW 2tn) from 2025, all listed from 2030.",
     "KRX listing rule non-compliance; financial supervisory penalties.",
     "Financial Services Commission, KRX"),
    ("Netherlands",
     ["EU CSRD", "EU Taxonomy", "Dutch Climate Agreement", "SFDR"],
     "CSRD applies to large Dutch companies from FY2024.",
     "AFM enforcement; CSRD non-compliance fines at member-state level.",
     "AFM (Authority for the Financial Markets)"),
    ("Sweden",
     ["EU CSRD", "Swedish Sustainability Act", "EU Taxonomy", "SFDR"],
     "CSRD large-company phase from FY2024; SMEs from FY2026.",
     "Swedish FSA enforcement; director liability under CSRD.",
     "Finansinspektionen (FI)"),
    (None,
     ["ISSB S1 & S2", "GRI Standards (voluntary)", "TCFD Recommendations", "UN Global Compact"],
     "ISSB standards are being adopted globally; check your local securities regulator.",
     "Vary by jurisdiction. Increasing trend toward mandatory disclosure with financial penalties.",
     "Local securities regulator and environmental agency"),
]

# Risk and opportunity templates.
# (kind, industry or None for the default set, ord, title, description, level).
# Placeholders: {size} = business size in lower case, {industry} = industry in
# lower case, {country}, {dl} = key deadlines, {fw} = the framework named by
# the row's slot (1-based index, or 0 for "first two joined by ', '"), or the
# row's fallback text when the country lists no such framework.
RISK_OPP_TEMPLATES = [
    ("risk", "Technology", 1, "E-Waste & Circular Economy Compliance",
     "As a {size} tech firm in {country}, e-waste disposal poses regulatory risk. {fw} may impose stricter reporting.",
     "High", 1, "Emerging regulations"),
    ("risk", "Technology", 2, "Data Centre Carbon Disclosure",
     "Growing compute demands increase carbon footprint. Under {fw}, emissions reporting is becoming mandatory. {dl}",
     "Medium", 2, "emerging standards"),
    ("risk", "Technology", 3, "Supply Chain Human Rights Risk",
     "Hardware supply chains may involve poor labour jurisdictions. {fw} require supply chain transparency.",
     "High", 3, "Due diligence laws"),
    ("risk", "Manufacturing", 1, "Carbon Emissions Cap Risk",
     "Manufacturing in {country} faces tightening emissions caps under {fw}. {dl}",
     "High", 1, "local regulations"),
    ("risk", "Manufacturing", 2, "Water & Pollution Reporting",
     "Industrial water use under scrutiny. {fw} mandate water impact disclosure.",
     "Medium", 2, "Environmental standards"),
    ("risk", "Manufacturing", 3, "Worker Safety Compliance",
     "Production facility health risks. {fw} may require enhanced due diligence.",
     "High", 3, "Labour laws"),
    ("risk", "Finance", 1, "Greenwashing Liability",
     "ESG fund labelling under scrutiny. {fw} impose strict requirements. {dl}",
     "High", 1, "Disclosure standards"),
    ("risk", "Finance", 2, "Stranded Asset & Transition Risk",
     "Fossil-fuel portfolio exposure. {fw} mandates climate-risk assessment.",
     "Medium", 2, "Climate stress testing"),
    ("risk", "Finance", 3, "Disclosure Compliance Burden",
     "Multiple frameworks ({fw}) require significant reporting infrastructure investment.",
     "Medium", 0, "various"),
    ("risk", "Financial Services", 1, "Greenwashing Liability",
     "ESG product labelling is under heightened scrutiny. {fw} impose strict anti-greenwashing requirements. {dl}",
     "High", 1, "Disclosure standards"),
    ("risk", "Financial Services", 2, "Stranded Asset & Transition Risk",
     "Portfolio exposure to high-carbon assets. {fw} mandates climate-risk scenario analysis.",
     "High", 2, "Climate stress testing"),
    ("risk", "Financial Services", 3, "Disclosure & Reporting Burden",
     "Multiple concurrent frameworks ({fw}) impose heavy reporting costs on {size} firms.",
     "Medium", 0, "various"),
    ("opportunity", "Technology", 1, "Green Software & Cloud Efficiency",
     "Energy cost reduction of 15-30%. Early {fw} compliance creates competitive advantage.",
     "High", 1, "standards"),
    ("opportunity", "Technology", 2, "Circular Economy Products",
     "Device refurbishment and take-back programmes open new revenue streams and reduce material costs.",
     "Medium", None, None),
    ("opportunity", "Technology", 3, "ESG-Driven Talent Attraction",
     "ESG-committed firms see 15-20% lower attrition in {country}.",
     "Medium", None, None),
    ("opportunity", "Manufacturing", 1, "Energy Efficiency Retrofits",
     "Plant upgrades in {country} can cut energy costs 20-40% with under 3-year payback.",
     "High", None, None),
    ("opportunity", "Manufacturing", 2, "Sustainable Materials Premium",
     "Recycled/bio-based inputs reduce emissions. Compliance with {fw} unlocks green procurement channels.",
     "High", 1, "standards"),
    ("opportunity", "Manufacturing", 3, "Certification Market Access",
     "ISO 14001 certification opens regulated procurement channels in {country}.",
     "Medium", None, None),
    ("opportunity", "Finance", 1, "Green Bond Products",
     "Green bonds aligned with {fw} attract ESG capital at favourable rates.",
     "High", 1, "standards"),
    ("opportunity", "Finance", 2, "ESG Analytics Services",
     "Proprietary ESG scoring tools and advisory services create premium revenue streams.",
     "Medium", None, None),
    ("opportunity", "Finance", 3, "Impact Investment Funds",
     "Dedicated impact funds capture growing institutional and retail demand for ESG products.",
     "High", None, None),
    ("risk", None, 1, "Regulatory Non-Compliance",
     "ESG regulations in {country} ({fw}) impose new requirements. {dl}",
     "High", 0, "evolving"),
    ("risk", None, 2, "Climate Physical & Transition Risk",
     "Extreme weather events and low-carbon transition create operational and financial risks across the value chain.",
     "Medium", None, None),
    ("risk", None, 3, "Talent & Social License Risk",
     "Weak ESG commitment hinders talent attraction and retention in {country}.",
     "Medium", None, None),
    ("opportunity", None, 1, "Operational Efficiency Gains",
     "Energy and resource efficiency measures can reduce operating costs for {size} {industry} businesses by 10-25%.",
     "High", None, None),
    ("opportunity", None, 2, "Brand Differentiation & Premium Pricing",
     "ESG positioning commands 5-15% premium valuations and improves customer loyalty.",
     "Medium", None, None),
    ("opportunity", None, 3, "Green Finance Access",
     "Credible ESG strategies in {country} unlock sustainability-linked loans at 20-50 bps lower rates.",
     "High", None, None),
]

# Solution catalogue (ord, name, category, description,
# cost_low, cost_high, savings, payback_years, fit_score); costs and savings
# are multiplied by the size cost scale.
SOLUTIONS = [
    (1, "Carbon Footprint Tracking Platform", "Environmental",
     "Deploy automated GHG emissions monitoring across Scope 1, 2, and 3 with real-time dashboarding.",
     15000, 50000, 8000, 3.0, 92),
    (2, "Renewable Energy Transition Plan", "Environmental",
     "Switch to 100% renewable electricity via PPAs or on-site solar/wind.",
     50000, 200000, 25000, 5.0, 88),
    (3, "DEI & Fair Labour Programme", "Social",
     "Implement DEI training, pay-equity audits, and transparent reporting.",
     10000, 40000, 5000, 4.0, 80),
    (4, "Supply Chain ESG Audit", "Governance",
     "Third-party audits of tier-1 and tier-2 suppliers for ESG compliance.",
     20000, 75000, 10000, 4.5, 85),
    (5, "ESG Reporting & Disclosure Framework", "Governance",
     "Adopt GRI/SASB/TCFD-aligned reporting for investor and regulatory disclosure.",
     8000, 30000, 3000, 5.0, 78),
    (6, "Waste Reduction & Circular Economy", "Environmental",
     "Redesign packaging, implement take-back programmes, set zero-waste-to-landfill targets.",
     12000, 45000, 7000, 3.5, 75),
]

# Fixed values: +5 fit boost per industry (industry, solution names).
INDUSTRY_BOOSTS = [
    ("Technology", ["Carbon Footprint Tracking Platform", "ESG Reporting & Disclosure Framework"]),
    ("Manufacturing", ["Waste Reduction & Circular Economy", "Renewable Energy Transition Plan"]),
    ("Finance", ["ESG Reporting & Disclosure Framework", "Supply Chain ESG Audit"]),
    ("Financial Services", ["ESG Reporting & Disclosure Framework", "Supply Chain ESG Audit"]),
    ("Energy", ["Renewable Energy Transition Plan", "Carbon Footprint Tracking Platform"]),
    ("Healthcare", ["DEI & Fair Labour Programme", "Supply Chain ESG Audit"]),
    ("Retail", ["Waste Reduction & Circular Economy", "Supply Chain ESG Audit"]),
]

# Size scales.
COST_SCALE = {"Small": 0.3, "Medium": 1.0, "Large": 2.5}   # default 1.0
KPI_SCALE = {"Small": 1.0, "Medium": 1.5, "Large": 2.0}    # default 1.0

# KPI templates (ord, kpi, base, improvement %); the carbon base
# is multiplied by the KPI size scale.
KPI_TEMPLATES = [
    (1, "Carbon Emissions (tCO₂e)", 1000, -15),
    (2, "Energy Efficiency (%)", 60, 12),
    (3, "Employee Satisfaction (%)", 65, 10),
    (4, "Waste Diversion Rate (%)", 40, 20),
    (5, "ESG Disclosure Score", 55, 18),
]

# Measured baselines for KPI projections (metric, kpi, improvement %).
KPI_MEASURED = [
    ("carbon_emissions", "Carbon Emissions (tCO₂e)", -15),
    ("energy", "Energy Consumption (MWh)", -10),
    ("gender_diversity", "Gender Diversity (%)", 8),
    ("waste_recycled", "Waste Diversion Rate (%)", 20),
    ("employee_turnover", "Employee Turnover (%)", -12),
]

# Trend-based KPI projections (metric, kpi, improvement %).
KPI_IMPROVEMENT_MAP = [
    ("carbon_emissions", "Carbon Emissions (tCO₂e)", -15),
    ("renewable_energy", "Renewable Energy (%)", 12),
    ("waste_recycled", "Waste Recycled (%)", 15),
    ("gender_diversity", "Gender Diversity (%)", 8),
    ("employee_turnover", "Employee Turnover (%)", -20),
    ("board_independence", "Board Independence (%)", 10),
    ("energy", "Energy Consumption (MWh)", -10),
    ("water", "Water Usage (m³)", -12),
    ("safety", "Safety Incidents", -30),
]

# Compliance timeline shown on the dashboard (phase, timeframe,
# actions, deliverable) and in the detailed report (timeframe, phase, actions,
# deliverable).
DASHBOARD_TIMELINE = [
    ("Assessment", "Months 1-2", "Regulatory gap analysis, baseline measurement", "Gap report"),
    ("Foundation", "Months 3-4", "Reporting framework selection & setup", "Initial disclosure draft"),
    ("Implementation", "Months 5-8", "Core ESG initiatives, data collection", "Progress dashboards"),
    ("Verification", "Months 9-12", "Third-party audit, board review", "Compliance certification"),
    ("Maintenance", "Ongoing", "Continuous monitoring & reporting", "Annual ESG report"),
]
REPORT_TIMELINE = [
    ("Months 1-2", "Assessment", "Gap analysis, baseline measurement", "Compliance gap report"),
    ("Months 3-4", "Foundation", "Reporting framework selection & setup", "Initial disclosure draft"),
    ("Months 5-8", "Implementation", "Core ESG initiatives, data collection", "Progress dashboards"),
    ("Months 9-12", "Verification", "Third-party audit, board review", "Compliance certification"),
    ("Ongoing", "Maintenance", "Continuous monitoring & reporting", "Annual ESG report"),
]

# Allowed form choices when a profile field is missing.
FORM_INDUSTRIES = ["Technology", "Healthcare", "Finance", "Financial Services", "Manufacturing",
                   "Retail", "Energy", "Agriculture", "Construction", "Transportation", "Education",
                   "Telecommunications", "Pharmaceuticals", "Automotive", "Real Estate", "Hospitality",
                   "Mining", "Oil And Gas", "Utilities", "Consumer Goods", "Other"]
FORM_COUNTRIES = ["United States", "United Kingdom", "Canada", "Germany", "France", "Japan", "China",
                  "India", "Australia", "Brazil", "South Korea", "Mexico", "Italy", "Spain",
                  "Netherlands", "Switzerland", "Singapore", "Sweden", "Norway", "Denmark", "Other"]
FORM_DEFAULTS = {"employee_count": 100, "budget": 100000.0}
FORM_RANGES = {"employee_count": (1, 500000), "budget": (1000.0, 100000000.0)}
REQUIRED_PROFILE_FIELDS = ["employee_count", "budget", "industry", "country"]

# Profile extraction from free text (patterns run on lower-case text).
EMPLOYEE_PATTERNS = [
    r"(\d[\d,]*)\s*employees",
    r"employee\s*(?:count|number|size)[:\s]*(\d[\d,]*)",
    r"headcount[:\s]*(\d[\d,]*)",
    r"staff\s*(?:of|size)?[:\s]*(\d[\d,]*)",
    r"workforce[:\s]*(\d[\d,]*)",
]
BUDGET_PATTERNS = [
    r"(?:budget|spend|investment|willing\s*to\s*spend)[:\s]*\$?([\d,]+(?:\.\d+)?)\s*(k|m|million|thousand|billion)?",
    r"\$\s*([\d,]+(?:\.\d+)?)\s*(k|m|million|thousand|billion)?",
]
BUDGET_MULTIPLIERS = {"k": 1000, "thousand": 1000, "m": 1000000, "million": 1000000,
                      "billion": 1000000000}
TEXT_INDUSTRIES = ["technology", "healthcare", "finance", "financial services", "manufacturing",
                   "retail", "energy", "agriculture", "construction", "transportation",
                   "education", "telecommunications", "pharmaceuticals", "automotive",
                   "real estate", "hospitality", "mining", "oil and gas", "utilities",
                   "consumer goods"]
TEXT_COUNTRIES = ["united states", "united kingdom", "canada", "germany", "france", "japan",
                  "china", "india", "australia", "brazil", "south korea", "mexico", "italy",
                  "spain", "netherlands", "switzerland", "singapore", "sweden", "norway", "denmark"]

# Personal-data scrub, applied in this order (pattern, marker).
PII_MAX_CHARS = 2000
PII_MAX_CHARS_LOCAL = 8000
PII_RULES = [
    (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[EMAIL]"),
    (r"(\+?\d{1,3}[-. ]?)?\(?\d{2,4}\)?[-. ]?\d{3,4}[-. ]?\d{3,4}", "[PHONE]"),
    (r"https?://\S+", "[URL]"),
    (r"\b[A-Z]{2,3}-?\d{5,10}\b", "[ID]"),
]

# Field texts a pandas CSV read treats as missing by default.
CSV_NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
                 "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# Question routing; first group with a contained keyword wins.
INTENT_KEYWORDS = [
    ("budget", ["budget", "spend", "cost", "invest"]),
    ("workforce", ["employee", "hire", "staff", "headcount", "workforce"]),
    ("timeline", ["timeline", "when", "how long", "duration"]),
    ("risk", ["risk", "regulation", "compliance", "penalty", "fine"]),
    ("carbon", ["carbon", "emission", "climate", "scope"]),
]
INTENT_DEFAULT = "general"

# Latin-1 replacements for report text, in order (char, replacement).
LATIN1_REPLACEMENTS = [
    ("\u2013", "-"), ("\u2014", "-"), ("\u2018", "'"), ("\u2019", "'"),
    ("\u201c", '"'), ("\u201d", '"'), ("\u2026", "..."), ("\u2022", "-"),
    ("\u00a0", " "), ("\u2010", "-"), ("\u2011", "-"), ("\u2012", "-"),
    ("\u00b7", "-"), ("\u2082", "2"), ("\u2081", "1"), ("\u2083", "3"),
    ("\u00b2", "2"), ("\u00b3", "3"), ("\u00ae", "(R)"), ("\u2122", "(TM)"),
    ("\u00a9", "(c)"), ("\u20ac", "EUR"), ("\u00a3", "GBP"), ("\u00b0", "deg"),
    ("\u2264", "<="), ("\u2265", ">="), ("\u2260", "!="), ("\u00d7", "x"),
]

# Message formats (printf style, as used with format_string).
MSG_DUPLICATES = "Found %d duplicate row(s). Consider deduplicating."
MSG_MISSING = "Column '%s' has %.1f%% missing values."
MSG_FEW_ROWS = "Dataset has fewer than 2 rows – results may be unreliable."
MSG_CONSTANT = "Column '%s' has only one unique value (constant)."
# Grades by least score; steps of the maturity scores ("above" -> points, the last for the rest)
# by budget per employee, employees and budget.
GRADES = [(80, "A"), (65, "B"), (50, "C"), (35, "D"), (None, "F")]
MATURITY_BUDGET_STEPS = [(2000, 72), (1000, 58), (500, 45), (None, 32)]
MATURITY_STAFF_STEPS = [(1000, 60), (500, 55), (100, 45), (None, 35)]
MATURITY_TOTAL_STEPS = [(1_000_000, 68), (500_000, 60), (200_000, 52), (50_000, 40), (None, 30)]
MATURITY_RATIONALE = ("Based on a %s %s company with %,d employees and $%s ESG budget. Environmental score reflects "
                      "per-employee commitment of $%s. Social score accounts for workforce scale and industry norms. "
                      "Governance score considers budget magnitude and disclosure readiness.")

YEAR_RULE_WORDS = ["year", "date"]
YEAR_RULE_KINDS = ["data", "dates"]
MSG_YEAR_PASS = "✅ Data constraint check passed – all records are from 2010 onwards."
MSG_YEAR_SKIP = "No year/date column found – temporal validation skipped."
MSG_YEAR_FAIL = "Column '%s' contains %s from %d, before 2010."
MSG_SCORE_RATIONALE = ("Scored from actual uploaded data. E based on %d metric(s), S based on %d metric(s), "
                       "G based on %d metric(s).")
MSG_GAP_BELOW = "**%s**: %+.1f points below industry average. Target: %.1f (avg) / %.1f (top quartile)"

# Prompt-context caps (characters) for the text attached to
# narrative, risk, solution and what-if prompts.
PROMPT_CAPS = {"narrative": 500, "risks": 800, "solutions": 600, "what_if": 600}

# What-if answers by intent; {slots} are filled per company.
WHATIF_ANSWERS = {
    "budget": (
        "**Budget Impact Analysis**\n\n"
        "Based on your profile ({size} {industry} company, {employees} employees, ${budget} ESG budget):\n\n"
        "| Scenario | Budget | Impact |\n|----------|--------|--------|\n"
        "| Optimistic | +20% (${budget_up}) | Payback drops from 5.0 to ~3.8 years |\n"
        "| Base Case | ${budget} | Implement top 2 solutions |\n"
        "| Pessimistic | -20% (${budget_down}) | Carbon Tracking only (Scope 1&2) |\n\n"
        "*Regulatory note:* {first_framework} may mandate disclosure spend regardless.\n\n"
        "**Recommendation:** Prioritise highest-ranked solutions and phase in others over 2-3 years."),
    "workforce": (
        "**Workforce Impact Projection**\n\n"
        "| Metric | Current | Projected (12mo) |\n|--------|---------|------------------|\n"
        "| ESG HR Capacity | ~0 FTE | +{fte} FTE |\n"
        "| Employee Satisfaction | Baseline | +10-15% |\n"
        "| Attrition Savings | $0 | ~${attrition}/yr |\n"
        "| Talent Acquisition Cost | Baseline | -8-12% |\n\n"
        "**Recommendation:** Appoint a dedicated ESG lead before scaling initiatives."),
    "timeline": (
        "**Implementation Timeline**\n\n"
        "| Phase | Duration | Key Activities | Regulatory Milestone |\n|-------|----------|----------------|---------------------|\n"
        "| Assessment | Months 1-2 | Baseline, gap analysis | Gap report vs {first_standard} |\n"
        "| Quick Wins | Months 3-4 | Carbon tracking, reporting setup | Initial disclosure prep |\n"
        "| Core Build | Months 5-12 | Renewable transition, audits | Compliance milestone |\n"
        "| Maturity | Months 12-24 | Full integration, verification | Full reporting readiness |\n\n"
        "*Key deadline:* {deadlines}\n\n"
        "**Recommendation:** Start Assessment phase this quarter to meet upcoming deadlines."),
    "risk": (
        "**Regulatory Risk Scenario**\n\n"
        "**Frameworks:** {two_frameworks}\n"
        "**Deadline:** {deadlines}\n\n"
        "| Scenario | Likelihood | Financial Impact |\n|----------|-----------|------------------|\n"
        "| Non-compliance fines | Medium-High | $50K–$500K |\n"
        "| Procurement exclusion | Medium | 10-25% revenue loss |\n"
        "| Proactive compliance | Recommended | ${cost_low}–${cost_high} |\n\n"
        "*Verdict:* Cost of inaction is 3-5× proactive adoption. {penalties}\n\n"
        "**Recommendation:** Begin compliance programme immediately."),
    "carbon": (
        "**Carbon Reduction Scenario**\n\n"
        "| Timeframe | Reduction Target | Cumulative Reduction |\n|-----------|-----------------|---------------------|\n"
        "| Year 1 | 15-20% Scope 1&2 | 15-20% |\n"
        "| Years 2-3 | +25-35% renewable | ~50% |\n"
        "| Year 5 | +10-20% circularity | 60-70% |\n\n"
        "Potential carbon credit value: ${credit_low}–${credit_high}/year.\n\n"
        "**Recommendation:** Deploy Carbon Footprint Tracking first to establish a verified baseline."),
    "general": (
        "**Predictive Analysis – {industry}**\n\n"
        "For your {size} business ({employees} employees, ${budget} budget):\n\n"
        "- ESG disclosure score: **+18-25 points** in 12 months\n"
        "- Operational cost reduction: **10-15%** via efficiency measures\n"
        "- Revenue uplift: **4-7%** from ESG brand positioning\n\n"
        "**Regulatory context:** {two_frameworks}\n\n"
        "Try asking about budgets, carbon emissions, implementation timelines, or workforce impact."),
}
# What stands in an answer for a field that is not there.
WHATIF_DEFAULTS = {"industry": "your industry", "size": "your", "first_framework": "Emerging standards",
                   "first_standard": "standards"}

# User prompts of the narrative, the risks and the ranking of solutions.
PROMPTS = {
    "narrative": (
        "Company: {industry} sector, {country}, {employees} employees, ${budget} ESG budget.\n"
        "ESG Maturity: Overall {overall}/100 (Grade {grade}), E={environmental}, S={social}, G={governance}.\n"
        "Top solutions: {solutions}.\n"
        "Regulatory: {three_frameworks}.\n"
        "Key deadline: {deadlines}.\n"
        "{insights}"),
    "risks": (
        "Company profile:\n- Industry: {industry}\n- Country: {country}\n- Business Size: {business_size}\n\n"
        "Regulatory frameworks: {frameworks}\nKey deadlines: {deadlines}\nRegulator: {regulator}\n"
        "{risk_data}\nGenerate ESG risks and opportunities."),
    "solutions": (
        "Industry: {industry}\nBusiness Size: {business_size}\nESG Budget: ${budget}\n"
        "{solution_data}\nRank 6 ESG solutions."),
}

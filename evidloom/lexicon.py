"""Term lists of the default evidence lexicon. They are data: every operator takes its terms as an argument."""

from __future__ import annotations

# The categories of evidence and their keywords.
CATEGORY_KEYWORDS: dict[str, tuple[str, ...]] = {
    "risk_management": ("risk assessment", "risk management", "risk register", "risk owner", "risk review", "risikoanalyse"),
    "incident_reporting": ("incident response", "incident reporting", "incident timeline", "24 hours", "72 hours", "meldepflicht"),
    "business_continuity": ("business continuity", "backup restore", "recovery time", "continuity exercise", "disaster recovery"),
    "supplier_security": ("supplier security", "supplier review", "vendor security", "third party", "contractual security"),
    "access_control": ("access control", "least privilege", "multi-factor authentication", "mfa", "access review", "privileged access"),
    "vulnerability_management": ("vulnerability management", "patch management", "security patch", "remediation timeline", "vulnerability scan"),
    "secure_development": ("secure development", "secure maintenance", "secure acquisition", "vulnerability disclosure", "change control", "software security"),
    "control_effectiveness": ("control effectiveness", "effectiveness review", "control testing", "security metrics", "control assessment", "wirksamkeitspruefung"),
    "cyber_hygiene_training": ("cyber hygiene", "cybersecurity training", "security awareness", "awareness training", "phishing training", "sicherheitsschulung"),
    "cryptography_encryption": ("cryptography", "encryption", "encryption policy", "key management", "verschluesselung", "kryptographie"),
    "asset_management": ("asset management", "asset inventory", "asset register", "device inventory", "inventory review", "inventarisierung"),
    "secure_auth_communications": ("strong authentication", "continuous authentication", "secure communications", "secured communications", "emergency communication", "secure voice", "secure text"),
}

# Topics of a text and the aliases that show them.
TOPIC_ALIASES: dict[str, tuple[str, ...]] = {
    "access_control": ("access control", "access review", "least privilege", "role based access", "rollen und rechte", "zugriffskontrolle"),
    "mfa": ("2fa", "mfa", "multi factor", "multi-factor", "multifaktor", "strong authentication"),
    "identity_lifecycle": ("deprovision", "identity lifecycle", "joiner mover leaver", "leaver", "onboarding and offboarding", "user lifecycle"),
    "privileged_access": ("admin account", "pam", "privileged access", "privileged account", "service account"),
    "backup": ("backup", "backup policy", "datensicherung", "immutable backup", "offsite backup"),
    "restore_test": ("disaster recovery test", "restore test", "restoration test", "recovery test", "wiederherstellungstest"),
    "incident_response": ("72 hours", "incident response", "incident timeline", "meldepflicht", "security incident"),
    "business_continuity": ("business continuity", "bcm", "continuity exercise", "emergency plan", "notfallplan"),
    "patch_management": ("patch management", "patch schedule", "security patch", "update cadence", "update management"),
    "vulnerability_management": ("remediation timeline", "vulnerability management", "vulnerability scan", "vulnerability tracking", "weakness remediation"),
    "logging_monitoring": ("audit log", "central logging", "log monitoring", "monitoring alert", "siem"),
    "asset_inventory": ("asset inventory", "asset register", "device inventory", "inventarisierung", "software inventory"),
    "supplier_management": ("supplier review", "supplier security", "third party", "vendor assessment", "vendor security"),
    "data_protection": ("data protection", "data processing", "dpa", "dsgvo", "personal data", "privacy"),
    "encryption": ("encryption", "encryption at rest", "key management", "tls", "verschluesselung"),
    "awareness_training": ("awareness training", "cybersecurity training", "phishing training", "security awareness", "sicherheitsschulung"),
    "risk_management": ("risk assessment", "risk management", "risk owner", "risk register", "risikoanalyse"),
    "policy_governance": ("annual review", "approved policy", "governance", "policy owner", "review cadence", "richtlinie"),
    "sbom": ("bill of materials", "cyclonedx", "sbom", "software bill of materials", "software supply chain"),
    "secure_development": ("secure coding", "secure development", "secure maintenance", "security review", "software security"),
    "change_management": ("change approval", "change control", "change management", "release approval", "rollback plan"),
}

# Terms that raise or lower a passage's score.
BOOST_TERMS = (
    "verfahren", "dokumentiert", "umgesetzt", "implementiert", "verpflichtet", "richtlinie", "kontinuierlich", "regelmaessig", "risikoanalyse", "sicherheitsvorfall", "meldepflicht", "audit",
    "approved", "continuous", "documented", "implemented", "monitored", "owner", "policy", "procedure", "regularly", "review", "tested",
)
PENALTY_TERMS = (
    "fehlt", "luecke", "nicht umgesetzt", "nicht dokumentiert", "verstoss", "unzureichend", "mangelhaft", "nicht definiert", "ad hoc", "gap", "intentionally avoids", "missing", "no evidence", "no owner",
    "no review", "not defined", "not documented", "not implemented", "planned only", "unclear", "vague",
)
CRITICAL_TERMS = ("verstoss", "luecke", "nicht definiert", "mangelhaft", "gap", "missing", "no evidence", "no review", "not defined", "not documented")
CONTEXT_BOOST_TERMS = ("verpflichtet", "umgesetzt", "implementiert", "dokumentiert", "verfahren", "richtlinie", "kontinuierlich", "regelmaessig", "risikoanalyse", "sicherheitsvorfall", "meldepflicht", "audit")
CONTEXT_NEGATIVE_TERMS = ("fehlt", "luecke", "nicht umgesetzt", "nicht dokumentiert", "verstoss", "risiko", "unzureichend", "mangelhaft")
GAP_TERMS = ("ad hoc", "gap", "missing", "no owner", "no review", "not defined", "not documented", "not implemented", "planned only", "unclear", "vague")

# Families of negative signals and of concrete features.
NEGATIVE_SIGNALS: dict[str, tuple[str, ...]] = {
    "marketing_only": ("brochure", "marketing", "market-leading", "world class", "world-class", "we care", "we value security", "strategic priority", "intentionally avoids"),
    "template_only": ("template", "placeholder", "planned only", "to be completed", "tbd", "not defined"),
    "outdated": ("outdated", "expired", "last reviewed 2021", "last reviewed 2022", "last reviewed 2023", "review date: 2021", "review date: 2022", "review date: 2023"),
    "vague_control": ("ad hoc", "best effort", "important", "should", "vague", "not documented", "no evidence"),
}
CONCRETE_FEATURES: dict[str, tuple[str, ...]] = {
    "owner": ("accountable", "assigned to", "ciso", "committee", "owner", "responsible", "role", "team"),
    "review_or_frequency": ("annually", "biannual", "cadence", "daily", "every six months", "monthly", "quarterly", "review", "review date", "reviewed", "twice per year", "weekly"),
    "process_or_control": ("approved", "control", "documented", "implemented", "procedure", "process", "richtlinie", "runbook", "tested", "workflow"),
    "output_or_evidence": ("evidence", "export", "log", "notes", "record", "records", "report", "result", "ticket"),
}
# Features that count for one category only: category, feature, terms.
CATEGORY_FEATURES = (
    ("incident_reporting", "timeline", ("24 hours", "72 hours", "escalation", "meldepflicht", "timeline", "within")),
    ("supplier_security", "supplier_control", ("contractual", "due diligence", "onboarding", "questionnaire", "review", "security requirements")),
    ("secure_development", "secure_development", ("change control", "secure acquisition", "secure development", "secure maintenance", "software security", "vulnerability disclosure")),
    ("control_effectiveness", "control_effectiveness", ("control assessment", "control effectiveness", "control testing", "effectiveness review", "security metrics", "wirksamkeitspruefung")),
    ("cyber_hygiene_training", "training", ("awareness training", "cyber hygiene", "cybersecurity training", "phishing training", "security awareness", "sicherheitsschulung")),
    ("cryptography_encryption", "cryptography", ("cryptography", "encryption", "encryption policy", "key management", "kryptographie", "verschluesselung")),
    ("asset_management", "asset_inventory", ("asset inventory", "asset management", "asset register", "device inventory", "inventory review", "inventarisierung")),
    ("secure_auth_communications", "secure_authentication_or_communication", ("continuous authentication", "emergency communication", "secure communications", "secure text", "secure voice", "secured communications", "strong authentication")),
)
# Signals raised when a category's own terms are absent: category, signal, terms.
ABSENCE_SIGNALS = (("incident_reporting", "missing_timeline", CATEGORY_FEATURES[0][2]), ("supplier_security", "vague_supplier_controls", CATEGORY_FEATURES[1][2]))
# Signals that make a warning.
HARD_SIGNALS = ("marketing_only", "template_only", "outdated", "missing_timeline", "vague_supplier_controls")

# Terms of a chunk's score.
CONCRETE_TERMS = ("approved", "assigned", "documented", "evidence", "implemented", "monthly", "owner", "quarterly", "record", "reviewed", "tested")
NEGATIVE_TERMS = ("ad hoc", "missing", "no evidence", "not defined", "not documented", "planned only", "placeholder", "tbd")
STALE_TERMS = ("expired", "last reviewed 2021", "last reviewed 2022", "last reviewed 2023", "outdated", "superseded")
CONFLICT_TERMS = ("conflicting evidence", "contradicts", "exception not approved", "however no", "not consistently")

# Boolean features of an item.
ITEM_FEATURES: dict[str, tuple[str, ...]] = {
    "has_policy_owner": ("owner", "policy owner", "process owner", "responsible", "verantwortlich", "verantwortliche"),
    "has_backup_terms": ("backup", "restore", "restoration", "disaster recovery", "recovery time", "wiederherstellung"),
    "has_incident_terms": ("incident", "incident response", "incident reporting", "escalation", "vorfall", "meldeweg"),
    "has_supplier_terms": ("supplier", "vendor", "third party", "third-party", "lieferant", "dienstleister"),
    "has_review_terms": ("review", "reviewed", "audit", "tested", "approved", "überprüfung", "geprüft"),
    "contains_future_tense": ("planned", "will implement", "will be", "future", "roadmap", "soll", "wird eingeführt", "geplant"),
    "contains_negative_phrase": ("no evidence", "not documented", "not reviewed", "not tested", "missing", "intentionally avoids", "kein nachweis", "nicht dokumentiert"),
}
WEAK_LABELS: dict[str, tuple[str, ...]] = {
    "backup_evidence": ("backup", "restore", "restoration", "recovery time", "disaster recovery"),
    "incident_response_evidence": ("incident response", "incident reporting", "escalation", "72 hours", "vorfall"),
    "supplier_security_evidence": ("supplier security", "supplier review", "vendor security", "third party", "lieferant"),
    "access_control_evidence": ("access control", "least privilege", "mfa", "multi-factor", "privileged access"),
    "sbom_evidence": ("sbom", "cyclonedx", "component", "package url", "checksum"),
    "policy_document": ("policy", "procedure", "richtlinie", "prozess", "standard"),
    "audit_or_certificate": ("audit", "certificate", "certification", "iso 27001", "soc 2", "attestation"),
    "questionnaire": ("questionnaire", "question_id", "answer_status", "review_items", "fragebogen"),
}
DOCUMENT_LABELS = ("audit_or_certificate", "policy_document", "questionnaire")
LABEL_CONFLICT_TERMS = ("no evidence", "not documented", "not reviewed", "missing", "kein nachweis")

# Reference controls, the terms that suggest them, and the categories whose evidence covers them.
CONTROL_TERMS: dict[str, tuple[str, ...]] = {
    "NIS2-SCRM-01": ("supplier security", "supplier review", "vendor security", "third party", "due diligence", "contractual security", "lieferant"),
    "NIS2-SCRM-02": ("incident response", "incident reporting", "incident timeline", "supplier incident", "escalation", "72 hours", "vorfall"),
    "NIS2-SCRM-03": ("vulnerability management", "patch management", "security patch", "remediation timeline", "change control", "secure development", "sbom"),
    "NIS2-SCRM-04": ("business continuity", "backup restore", "backup", "restore", "disaster recovery", "continuity exercise", "recovery time"),
    "NIS2-SCRM-05": ("access control", "least privilege", "multi-factor authentication", "mfa", "access review", "privileged access", "secure communications"),
}

# The topics of the coverage matrix with the categories whose evidence covers them.
CONTROL_CATEGORIES: dict[str, tuple[str, ...]] = {
    "nis2_art_21_2_a": ("risk_management",),
    "nis2_art_21_2_b": ("incident_reporting",),
    "nis2_art_21_2_c": ("business_continuity",),
    "nis2_art_21_2_d": ("supplier_security",),
    "nis2_art_21_2_e": ("vulnerability_management", "secure_development"),
    "nis2_art_21_2_f": ("control_effectiveness",),
    "nis2_art_21_2_g": ("cyber_hygiene_training",),
    "nis2_art_21_2_h": ("cryptography_encryption",),
    "nis2_art_21_2_i": ("access_control", "asset_management"),
    "nis2_art_21_2_j": ("secure_auth_communications", "access_control"),
}
# The controls that a category's evidence speaks to.
CATEGORY_CONTROLS: dict[str, list[str]] = {
    "access_control": ["NIS2-SCRM-05"], "asset_management": ["NIS2-SCRM-05"], "business_continuity": ["NIS2-SCRM-04"], "incident_reporting": ["NIS2-SCRM-02"],
    "secure_auth_communications": ["NIS2-SCRM-05"], "secure_development": ["NIS2-SCRM-03"], "supplier_security": ["NIS2-SCRM-01"], "vulnerability_management": ["NIS2-SCRM-03"],
}
# Claims that no statement may make.
FORBIDDEN_CLAIMS = (r"\bnis\s*-?\s*2\s*(?:compliant|konform)\b", r"\biso\s*(?:27001\s*)?(?:certified|zertifiziert)\b")

#: A small lexicon whose words the synthetic corpus does use, for queries over it.
CORPUS_CATEGORIES: dict[str, tuple[str, ...]] = {
    "access": ("access rights", "remote logins", "admin accounts", "zugriffsrechte", "fernzugänge"),
    "continuity": ("backup copies", "restore exercises", "continuity plans", "sicherungskopien", "notfallpläne"),
    "incidents": ("incident reports", "störungsmeldungen"),
    "suppliers": ("supplier contracts", "vendor audits", "lieferantenverträge"),
    "changes": ("change requests", "patch windows", "änderungsanträge", "wartungsfenster"),
    "assets": ("asset lists", "inventarlisten"),
}
CORPUS_BOOST = ("audit", "review", "approved", "documented", "owner", "tested", "recorded", "dokumentiert", "geprüft", "freigegeben")
CORPUS_PENALTY = ("missing", "unclear", "unsigned", "no owner", "stale", "fehlte", "unklar", "rejected", "abgelehnt")
CORPUS_CRITICAL = ("exceeded", "failed", "unreadable", "unlesbar")

"""Controlled vocabularies and lookup tables. They must equal the original system's for right results."""

from __future__ import annotations

#: Title keyword -> (label, site), in matching order.
RTO_KEYWORDS = {
    "PJM": ("PJM", "https://www.pjm.com/Home/Calendar.aspx"),
    "CAISO": ("CAISO", "https://www.caiso.com/meetings-events/calendar"),
    "MISO": ("MISO", "https://www.misoenergy.org/engage/tools/calendar"),
    "NYISO": ("NYISO", "https://www.nyiso.com/calendar"),
    "ERCOT": ("ERCOT", "https://www.ercot.com/calendar"),
    "SPP": ("SPP Markets +", "https://www.spp.org/events/"),
    "NEPOOL": ("NEPOOL", "https://nepool.com/calendar/"),
    "ISO-NE": ("ISO-NE", "https://www.iso-ne.com/calendar"),
    "NERC": ("NERC", "https://www.nerc.com/Pages/Calendar.aspx"),
    "FERC": ("FERC", "https://www.ferc.gov/news-events/events"),
}
#: Committee keywords of each label. The joined last PJM keyword is as in the original.
COMMITTEE_KEYWORDS = {
    "NYISO": ["Management Committee", "Business Issues Committee", "Operating Committee", "Installed Capacity", "Market Issues", "Price-Responsive Load", "Electric System Planning", "Transmission Planning Advisory", "Billing, Accounting & Credit Policy", "Load Forecasting", "Communication & Data Advisory", "System Operations Advisory"],
    "ISO-NE": ["Participants Committee", "Markets Committee", "Reliability Committee", "Transmission Committee", "Planning Advisory Committee", "Distributed Generation Forecast Working Group", "Load Forecasting", "Electric System Planning"],
    "PJM": ["Members Committee", "Markets and Reliability Committee", "Market Implementation Committee", "Planning Committee", "Risk Management Committee", "Transmission Expansion Advisory Committee", "Resource AdequacyOperating Committee"],
    "MISO": ["Market Subcommittee", "Planning Advisory Committee", "Planning Subcommittee", "Reliability Subcommittee", "Resource Adequacy Subcommittee", "Interconnection Process Working Group", "Regional Expansion Criteria and Benefits Working Group"],
    "SPP Markets +": ["Markets+ Participants Executive Committee", "Markets+ State Committee", "Markets and Operations Policy Committee", "REAL Team"],
    "ERCOT": ["Technical Advisory Committee", "Reliability and Markets Committee", "Finance and Audit Committee", "HR and Governance Committee", "Technology and Security Committee"],
}
#: Document type rules, in matching order.
DOC_RULES = [
    ("agenda", "agenda"), ("minutes", "minutes|draft-minutes"), ("presentation", "presentation|slide|briefing"), ("report", "report|summary|update"),
    ("vote", "vote|poll|ballot|motion"), ("manual", r"manual|m\d{2}"), ("matrix", "matrix"), ("issue-charge", "issue.?charge|problem.?statement"),
    ("proposal", "proposal|straw|issue.?paper"), ("comment", "comment"), ("tariff", "tariff|amendment"), ("decision", "decision|memo"),
]
PJM_DOC_RULES = [
    ("agenda", "agenda"), ("minutes", "minutes|draft-minutes"), ("presentation", "presentation|slide|briefing"), ("report", "report|summary|update|review"),
    ("vote", "vote|poll|ballot|motion"), ("manual", r"manual|m\d{2}"), ("matrix", "matrix"), ("issue-charge", "issue.?charge|problem.?statement"),
]
CAISO_DOC_RULES = [
    ("agenda", "agenda"), ("minutes", "minutes"), ("presentation", "presentation|slide"), ("proposal", "proposal|straw|issue-paper|issue paper"), ("comment", "comment"),
    ("tariff", "tariff|amendment"), ("report", "report|summary"), ("decision", "decision|memo"), ("workshop-paper", "workshop"), ("implementation", "implementation|milestone"),
]
JUNK_TITLES = ["", "pdf", "xls", "xlsx", "ppt", "pptx", "doc", "docx", "ashx", "csv", "zip", "download", "link"]
ACRONYMS = "PJM FERC CIFP RBP DR ELCC ELCCSTF RPM BRA FTR ARR IRM FRR LMP OATT RTEP DASR ICAP EKPC NITS CONE VRR RA IT EV DER BESS MC MRC MIC PC OC RMC TEAC FC AAC LC NC CDS DISRS IPS LAS RAAS RASTF RMDSTF DTS ISAC EDART PSEG PPL EDC DOM COMED NUG GIA ISA WMPA TO TOs EDCs".split()
COMMITTEES = {
    "Members Committee": "mc", "Markets and Reliability Committee": "mrc", "Market Implementation Committee": "mic", "Planning Committee": "pc", "Operating Committee": "oc", "Risk Management Committee": "rmc",
    "Transmission Expansion Advisory Committee": "teac", "Finance Committee": "fc", "Audit Advisory Committee": "aac", "Liaison Committee": "lc", "Nominating Committee": "nc",
    "Cost Development Subcommittee": "subcommittees/cds", "Distributed Resources Subcommittee": "subcommittees/disrs", "Interconnection Process Subcommittee": "subcommittees/ips", "Load Analysis Subcommittee": "subcommittees/las",
    "Resource Adequacy Analysis Subcommittee": "subcommittees/raas", "Resource Adequacy Senior Task Force": "task-forces/rastf", "Effective Load Carrying Capability Senior Task Force": "task-forces/elccstf", "Regulation Market Design Senior Task Force": "task-forces/rmdstf",
}
#: Sources whose documents are screened whatever their meeting's verdict.
SCREENED_ANYWAY = ["NYISO", "SPP", "SPP Markets +", "MISO", "ERCOT"]
TOPICS = ["price-formation", "ancillary-services", "ramping-flexibility", "capacity-ra", "storage", "hybrids-der", "mitigation-offers", "interconnection", "transmission", "load-growth", "ops-compliance", "seams-governance", "water-hydrology", "clean-energy", "ferc-policy"]
DIRECTNESS = {"direct": 3, "precedent": 2, "reference": 1}
ZONES = {
    "PJM": "America/New_York", "NYISO": "America/New_York", "ISO-NE": "America/New_York", "NEPOOL": "America/New_York", "FERC": "America/New_York", "NERC": "America/New_York",
    "CAISO": "America/Los_Angeles", "MISO": "America/Chicago", "SPP": "America/Chicago", "SPP Markets +": "America/Chicago", "ERCOT": "America/Chicago",
}
ZONE_OF_LETTER = {"E": "America/New_York", "C": "America/Chicago", "M": "America/Denver", "P": "America/Los_Angeles"}
#: Hours by which the zone of a letter is ahead of UTC in winter.
STANDARD_HOURS = {"E": -5, "C": -6, "M": -7, "P": -8}
ENTITY_ALIASES = {
    "pjm interconnection": "PJM", "pjm interconnection l.l.c": "PJM", "pjm interconnection llc": "PJM", "constellation energy": "Constellation", "constellation energy generation": "Constellation", "constellation power": "Constellation",
    "exelon generation": "Exelon", "duke energy ohio": "Duke Energy", "duke energy ohio & kentucky": "Duke Energy", "duke energy carolinas": "Duke Energy", "first energy": "FirstEnergy", "ferc": "FERC",
}
ENTITY_SUFFIX = r"[,.]?\s+(?:l\.?l\.?c\.?|llc|inc\.?|incorporated|corp\.?|corporation|co\.?|company|ltd\.?|limited|l\.?p\.?|llp|holdings?|group)\s*$"
#: Document types, most newsworthy first.
DOC_TYPE_ORDER = ["report", "decision", "proposal", "vote", "issue-charge", "tariff", "presentation", "matrix", "agenda", "comment", "minutes", "manual", "press-release", "elibrary", "other", "document"]
SUBJECT_TERM = r"(?i)\bhydro(?!gen|carbon)|pumped[\s\-]?storage|\bPSH\b|run[\s\-]?of[\s\-]?river"
EXCERPT_CHARS, HEAD_SHARE = 48000, 0.6
OMISSION = "\n\n[... MIDDLE OF DOCUMENT OMITTED FOR LENGTH — the text below resumes from a LATER page and does not continue the sentence above ...]\n\n"
#: Subtype that names no committee; kinds of meeting at the end of a slug; schedule tokens of each committee.
#: They must equal the original system's for right results.
CATCHALL_SUBTYPE = "Other Committees and Working Groups"
MEETING_SUFFIXES = ["net-conferences", "net-conference", "face-to-face", "annual-meeting", "zoom-meeting", "stakeholder-call", "conference-call", "meeting", "call"]
SCHEDULE_TOKENS = {
    "Business Issues Committee": ["BIC"], "Management Committee": ["MC"], "Operating Committee": ["OC"], "Installed Capacity Working Group": ["ICAP"],
    "Market Issues Working Group": ["MIWG"], "Price-Responsive Load Working Group": ["PRLWG"], "Electric System Planning Working Group": ["ESPWG"],
    "Transmission Planning Advisory Subcommittee": ["TPAS"], "Load Forecasting Task Force": ["LFTF"], "Billing, Accounting & Credit Policy Working Group": ["BACWG"],
    "Electric Gas Coordination Working Group": ["EGCWG"], "Budget & Priorities Working Group": ["BPWG"], "Business Intelligence Task Force": ["BITF"],
    "Interconnection Issues Task Force": ["IITF"], "Interconnection Project Facilities Study Working Group": ["IPFSWG", "IPFS"],
    "Inter-area Planning Stakeholder Advisory Committee": ["IPSAC"], "Communication & Data Advisory Subcommittee": ["CDAS"], "System Operations Advisory Subcommittee": ["SOAS"],
    "System Protection Advisory Subcommittee": ["SPAS"], "Market Participant Audit Advisory Subcommittee": ["MPAAS"], "Liaison Subcommittee": ["LIAISON"],
    "By-Laws Subcommittee": ["BY-LAWS", "BYLAWS"], "Appeals to the Board": ["APPEALS"], "Environmental Advisory Council": ["EAC"], "Customer Support Focus Group": ["CSFG"],
}
TOPIC_LABELS = {
    "price-formation": "Price Formation", "ancillary-services": "Ancillary Services", "ramping-flexibility": "Ramping & Flexibility", "capacity-ra": "Capacity & RA",
    "storage": "Storage & PSH", "hybrids-der": "Hybrids & DER", "mitigation-offers": "Mitigation & Offers", "interconnection": "Interconnection", "transmission": "Transmission",
    "load-growth": "Load Growth", "ops-compliance": "Ops & Compliance", "seams-governance": "Seams & Governance", "water-hydrology": "Water & Hydrology",
    "clean-energy": "Clean Energy", "ferc-policy": "FERC Policy",
}
CONFIDENCE = {
    "direct": "Direct — Changes a hydro or PSH revenue stream, obligation, or option",
    "precedent": "Precedent — Written for other resources or markets, but sets precedent for hydro",
    "reference": "Reference — Background or analysis, no specific hydro action",
}

"""Closed lists of the domain."""

#: Words of a vendor's legal form.
LEGAL_SUFFIXES = (
    "p pvt pvts prv prvt private ltd ltda lmtd limited llp llc lp inc incorporated corp corpn corporation co cos company plc opc "
    "gmbh ag sa sarl bv nv pte pty sdn bhd oy ab aps srl spa"
).split()

#: Words that banks put around a payment's narration.
NOISE_TOKENS = (
    "neft rtgs imps upi ach ecs nach chq chqno cheque chk dd ft trf tfr transfer txn tran trn trns inb mmt ref refno rrn utr "
    "inv invoice bill bills no nos num number payment payments pmt pmnt payt pay paid remittance remit rem settlement "
    "by to from via for of the and"
).split()

#: Words in front of a document number.
REFERENCE_PREFIXES = "inv invc invno invoice bill billno bl no nos num numb nbr ref refno reference doc docno document cn dn pi po pono gst tax".split()

#: Abbreviation and expansion.
ABBREVIATIONS = {
    "sw": "software", "softwares": "software", "svc": "services", "svcs": "services", "serv": "services", "servs": "services", "srv": "services",
    "srvc": "services", "srvcs": "services", "service": "services", "tech": "technologies", "techn": "technologies", "techno": "technologies",
    "technol": "technologies", "technology": "technologies", "sol": "solutions", "soln": "solutions", "solns": "solutions", "sols": "solutions",
    "solution": "solutions", "sys": "systems", "syst": "systems", "systs": "systems", "system": "systems", "engg": "engineering",
    "engr": "engineering", "engnr": "engineering", "intl": "international", "intnl": "international", "internatl": "international",
    "natl": "national", "natnl": "national", "mfg": "manufacturing", "mfr": "manufacturing", "mfrs": "manufacturing", "manuf": "manufacturing",
    "ind": "industries", "inds": "industries", "indus": "industries", "industry": "industries", "ent": "enterprises", "ents": "enterprises",
    "entp": "enterprises", "entps": "enterprises", "enterprise": "enterprises", "comm": "communications", "comms": "communications",
    "communication": "communications", "elec": "electronics", "elect": "electronics", "electronic": "electronics", "pharm": "pharmaceuticals",
    "pharma": "pharmaceuticals", "pharmaceutical": "pharmaceuticals", "lab": "laboratories", "labs": "laboratories", "laboratory": "laboratories",
    "dist": "distributors", "distr": "distributors", "distbtr": "distributors", "distributor": "distributors", "trdg": "trading",
    "assoc": "associates", "assocs": "associates", "associate": "associates", "bro": "brothers", "bros": "brothers", "brother": "brothers",
    "agy": "agencies", "agcy": "agencies", "agency": "agencies", "consultant": "consultants", "info": "information", "mgmt": "management",
    "mgt": "management", "eqpt": "equipment", "equip": "equipment", "prod": "products", "prods": "products", "product": "products", "grp": "group",
    "hldg": "holdings", "hldgs": "holdings", "holding": "holdings", "logi": "logistics", "logistic": "logistics", "pkg": "packaging",
    "chem": "chemicals", "chemical": "chemicals", "tex": "textiles", "textile": "textiles",
}

#: Hold type, releases itself, blocks accounting, severity.
HOLD_POLICIES = [
    ("matching", False, False, "material"),
    ("price_variance", False, False, "material"),
    ("quantity_variance", False, False, "material"),
    ("tax_variance", False, True, "blocking"),
    ("tax_amount_range", False, True, "blocking"),
    ("dist_variance", False, True, "blocking"),
    ("duplicate_candidate", False, True, "blocking"),
    ("no_reference", False, False, "material"),
    ("cardinality_residual", False, False, "material"),
    ("period_deferral", True, True, "advisory"),
    ("credit_note_crossing", False, True, "material"),
]

#: Fixed values, most pressing first: hold type, owner, resolution path.
ROUTING = [
    ("duplicate_candidate", "ap_manager", "internal_correction"),
    ("credit_note_crossing", "controller", "internal_correction"),
    ("period_deferral", "controller", "internal_correction"),
    ("tax_variance", "tax_team", "internal_correction"),
    ("tax_amount_range", "tax_team", "internal_correction"),
    ("dist_variance", "controller", "internal_correction"),
    ("price_variance", "requisitioner", "internal_correction"),
    ("quantity_variance", "requisitioner", "internal_correction"),
    ("cardinality_residual", "treasury", "re_application"),
    ("no_reference", "vendor", "customer_outreach"),
    ("matching", "ap_clerk", "re_application"),
]

#: Tolerance kind, hold type it can reach, basis.
REACH = [
    ("similarity", "matching", "declared"),
    ("similarity", "no_reference", "declared"),
    ("days", "matching", "declared"),
    ("days", "no_reference", "declared"),
    ("absolute_paise", "matching", "declared"),
    ("absolute_paise", "no_reference", "declared"),
    ("absolute_paise", "tax_amount_range", "declared"),
    ("absolute_paise", "tax_variance", "declared"),
    ("absolute_paise", "price_variance", "admissible"),
    ("absolute_paise", "cardinality_residual", "admissible"),
    ("percentage", "tax_variance", "declared"),
    ("percentage", "price_variance", "declared"),
    ("percentage", "matching", "declared"),
    ("percentage", "no_reference", "declared"),
    ("percentage", "quantity_variance", "admissible"),
    ("percentage", "cardinality_residual", "admissible"),
]

#: Hold types that no tolerance kind reaches.
UNREACHED = ["duplicate_candidate", "dist_variance", "period_deferral", "credit_note_crossing"]

#: Kinds of a tolerance.
TOLERANCE_KINDS = ["exact", "absolute_paise", "percentage", "days", "similarity"]

SEVERITY_RANK = {"advisory": 0, "material": 1, "blocking": 2}
AMOUNT_CAP, WINDOW_DAYS, MAX_POOL = 50_000_000, 45, 40
STRATA = ["clean", "duplicate", "tolerance", "cardinality", "reference", "period"]

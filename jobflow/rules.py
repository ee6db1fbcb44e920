"""Rule tables.

Everything in this module is a fixed value: word lists, lookup tables, constants,
patterns and formats that must equal the published behaviour for results to be right.
Operators take them as default parameters, so a caller can pass another table.
"""

# --- fixed values: company aliases (lower-case key -> display name) --------------------
COMPANY_ALIASES = {
    "3ds": "Dassault Systèmes",
    "3m": "3M",
    "altairpd": "Altair",
    "american honda": "Honda",
    "american honda honda": "Honda",
    "applied_materials_hr amat": "Applied Materials",
    "ansys talent acquisition": "Ansys",
    "ametek, inc": "AMETEK",
    "ametek talent acquisition team": "AMETEK",
    "arm": "Arm",
    "amgen amgen inc": "Amgen",
    "apple worldwide recruiting": "Apple",
    "broadcom": "Broadcom",
    "brunswick workday admin": "Brunswick",
    "bosch group": "Bosch",
    "boehringer ingelheim talent acquisition team confidential boehringer ingelheim": "Boehringer Ingelheim",
    "carnegie mellon university": "Carnegie Mellon University",
    "comsol human resources": "COMSOL",
    "cmu": "Carnegie Mellon University",
    "cybercoders": "CyberCoders",
    "ey": "EY",
    "ford careers": "Ford",
    "ford motor company": "Ford",
    "form energy recruiting": "Form Energy",
    "ge": "GE",
    "ge aerospace": "GE Aerospace",
    "ge vernova": "GE Vernova",
    "gkn aerospace recruitment team": "GKN Aerospace",
    "gkn aerospace recruitment team job": "GKN Aerospace",
    "gm": "General Motors",
    "hpe": "Hewlett Packard Enterprise",
    "idaho national laboratory": "Idaho National Laboratory",
    "john deere": "John Deere",
    "john deere recruiting": "John Deere",
    "llnl": "Lawrence Livermore National Laboratory",
    "lam talent acquisition lam research": "Lam Research",
    "millerknoll": "MillerKnoll",
    "meta hi": "Meta",
    "michelin group intouch": "Michelin",
    "maxxis international usa": "Maxxis International",
    "maxxis international - usa": "Maxxis International",
    "moog": "Moog",
    "ornl": "Oak Ridge National Laboratory",
    "ornl careers": "Oak Ridge National Laboratory",
    "panthalassa": "Panthalassa",
    "nvidia": "NVIDIA",
    "owens corning talent center": "Owens Corning",
    "recent siemens": "Siemens Energy",
    "sonoco": "Sonoco",
    "sgh": "Simpson Gumpertz & Heger",
    "simpson gumpertz & heger": "Simpson Gumpertz & Heger",
    "scion staffing": "Scion",
    "scout motors": "Scout Motors",
    "structural engineer at tait": "TAIT",
    "tait": "TAIT",
    "technia": "TECHNIA",
    "toyota research institute": "Toyota Research Institute",
    "tri": "Toyota Research Institute",
    "universal display corporation": "Universal Display Corporation",
    "vulcan elements": "Vulcan Elements",
    "westinghouse electric company": "Westinghouse",
    "westinghouse": "Westinghouse",
    "wilson sporting goods": "Wilson Sporting Goods",
    "workday no reply broadcom": "Broadcom",
    "wolfspeed wolfspeed": "Wolfspeed",
    "wolfspeed": "Wolfspeed",
    "zoox": "Zoox",
}

# --- fixed values: sender domain -> company (domains that name no company are left out) -
EMAIL_DOMAIN_COMPANIES = {
    "3ds.com": "Dassault Systèmes",
    "ansys.com": "Ansys",
    "apple.com": "Apple",
    "deere.com": "John Deere",
    "ge.com": "GE",
    "generalmotors.com": "General Motors",
    "hire.lever.co": "Lever",
    "hpe.com": "Hewlett Packard Enterprise",
    "linkedin.com": "LinkedIn",
    "millerknoll.com": "MillerKnoll",
    "nvidia.com": "NVIDIA",
    "openai.com": "OpenAI",
    "panthalassa.com": "Panthalassa",
    "scionstaffing.com": "Scion",
    "scoutmotors.com": "Scout Motors",
    "westinghouse.com": "Westinghouse",
}

# --- fixed values: words and names that are not companies ------------------------------
GENERIC_PREFIXES = [
    "application", "candidate", "careers", "hiring", "hr", "job", "jobs", "mail", "message",
    "no", "notifications", "noreply", "recruiting", "talent", "team", "thank", "update", "welcome",
]
GENERIC_COMPANIES = [
    "linkedin", "workday", "greenhouse", "icims", "smartrecruiters", "jobvite", "lever", "join",
    "applicantstack",
]
STUB_NAMES = ["the", "our", "this", "employment", "foundation", "form", "lawrence", "x"]
NAME_NOISE_WORDS = [
    "thank you", "application", "received", "response", "update", "important", "subject",
    "your", "dear", "hello", "hiring", "recruiting", "workday", "reply", "status", "successfactors",
]
TEAM_SUFFIXES = [
    "talent acquisition", "hiring team", "recruiting team", "recruitment team",
    "worldwide recruiting", "workday notifications",
]
DEPARTMENT_SUFFIXES = ["careers", "careerconnect", "hr"]
UPPER_WORDS = ["llnl", "cmu", "sgh", "tri", "hpe", "gm", "ge", "3m"]
LOWER_WORDS = ["and", "of", "the", "for", "to", "at", "in"]

# --- fixed values: applicant-tracking systems (fragment -> name) and vendor domains ------
ATS_DOMAIN_HINTS = {
    "myworkday.com": "workday",
    "greenhouse-mail.io": "greenhouse",
    "hire.lever.co": "lever",
    "jobvite.com": "jobvite",
    "smartrecruiters.com": "smartrecruiters",
    "teamtailor-mail.com": "teamtailor",
    "join.com": "join",
    "msg.join.com": "join",
    "dayforce.com": "dayforce",
    "icims.com": "icims",
    "acquiretm.com": "acquiretm",
    "successfactors": "successfactors",
    "workablemail.com": "workable",
    "workable.com": "workable",
    "ashbyhq.com": "ashby",
    "bamboohr.com": "bamboohr",
    "adp.com": "adp",
}
ATS_KEYWORD_HINTS = {
    "workday": "workday",
    "greenhouse": "greenhouse",
    "lever": "lever",
    "jobvite": "jobvite",
    "smartrecruiters": "smartrecruiters",
    "teamtailor": "teamtailor",
    "join.com": "join",
    "dayforce": "dayforce",
    "icims": "icims",
    "successfactors": "successfactors",
    "workable": "workable",
    "ashby": "ashby",
    "bamboohr": "bamboohr",
    "adp": "adp",
}
VENDOR_DOMAINS = [
    "myworkday.com", "greenhouse-mail.io", "hire.lever.co", "jobvite.com", "smartrecruiters.com",
    "teamtailor-mail.com", "join.com", "msg.join.com", "dayforce.com", "icims.com", "acquiretm.com",
    "successfactors.com", "workablemail.com", "workable.com", "ashbyhq.com", "bamboohr.com",
    "adp.com", "linkedin.com",
]
IMAGE_SUFFIXES = [".png", ".jpg", ".jpeg", ".svg"]

# --- fixed values: capture patterns over a mailbox row (case-insensitive) ----------------
# {name} is the lazily captured company, {stop} the tokens that end it, {owner} the mailbox
# owner's first name (a parameter; rows that need it are left out when it is not given).
NAME_CHARS = r"[A-Za-z0-9&.,'’()/ -]"
NAME_CAPTURE = r"([A-Z0-9]" + NAME_CHARS + r"+?)"
DATE_STOP = r"\s+\d{4}-\d{2}-\d{2}|\s+[A-Z][a-z]{2}\s+\d{2}-\d{2}|\s+\d{1,2}:\d{2}\s+[AP]M"
ROW_PATTERNS = [
    r"your application was sent to {name}\s+(?:\d{4}-\d{2}-\d{2}|[A-Z][a-z]{2}\s+\d{2}-\d{2}|\d{1,2}:\d{2}\s+[AP]M)\b",
    r"thank you for applying to {name}\s+-\s+",
    r"thank you for applying to {name}(?:{owner_stop}{stop}|[!.])",
    r"thanks? for applying to {name}(?:{owner_stop}{stop}|[!.])",
    r"thank you for applying at {name}(?:{owner_stop}{stop}|[!.])",
    r"thank you for your application to {name}\b",
    r"sign in and continue your application to {name}\b",
    r"information about your application to {name}\b",
    r"an update on your {name} application\b",
    r"update on your application to {name}\b",
    r"your application at {name}\b",
    r"thank you for your interest in {name}(?:{owner_stop}\s+and for applying|{stop})\b",
    r"thank you for your interest in .*? at {name}\b",
    r"thank you for expressing interest in the .*? role at {name}\s*\(",
    r"thank you for your interest in the .*? position at {name}\b",
    r"thanks? for expressing your interest in .*? at {name}\b",
    r"we have received your application for .*? at {name}\b",
    r"we received your submission for .*? at {name}\b",
    r"thank you for applying for .*? at {name}\b",
    r"thanks for applying to the .*? at {name}!",
    r"thank you for applying to the .*? opening at {name}\b",
    r"thank you for applying to the .*? position at {name}\b",
    r"for the position of .*? at {name}\b",
    r"received your application here at {name}\b",
    r"{name}\s+@\s+icims\b",
    r"dear {owner},\s+thank you very much for your recent application to {name}\s+for\b",
    r"application update on .*? at {name}\b",
]
SUBJECT_STARTS = [
    "Thank you", "Thanks for", "Regarding your", "Application ", "Application Update",
    "Status Update", "Your application", "Your interest", "Welcome to", "Subject:",
    "ORNL Acknowledge", "Sign in and continue", "Information about",
]
SENDER_CUTS = ["You don't often get email", " Inbox", "|"]
SENDER_SUFFIXES = [
    "Talent Acquisition", "Recruiting Team", "Recruitment Team", "Hiring Team",
    "Worldwide Recruiting", "Careers", "CareerConnect", "HR", "Workday Notifications",
]

# --- fixed values: registry clean-up ------------------------------------------------------
PERSONAL_DOMAINS = ["psu.edu"]
COMPOUND_SUFFIXES = ["co.uk", "com.au", "org.au"]
NOISE_NAME_PATTERNS = [
    r"\bthank you\b", r"\bapplication\b", r"\bapplications?\b", r"\bposition\b", r"\brole\b",
    r"\bjob\b", r"\bjobs\b", r"\bupdate\b", r"\bnotification\b", r"\bnotifications\b",
    r"\bsubject\b", r"\brecent\b", r"\brecruiting\b", r"\btalent acquisition\b",
    r"\bhiring team\b", r"\bhuman resources\b", r"\bcareerconnect\b", r"\bworkday\b",
    r"\bresume\b", r"\bdear\b", r"\bhello\b",
]
BARE_ROLES = ["manager", "engineer", "scientist", "analyst", "specialist"]
GENERIC_ROLE_WORDS = [
    "analyst", "cae", "design", "engineer", "fea", "lead", "manager", "mechanical", "modeling",
    "r", "research", "simulation", "specialist", "staff", "stress", "structural",
]
SPLIT_ROLE_WORDS = [
    "engineer", "scientist", "manager", "analyst", "specialist", "role", "opening", "position",
    "fea", "cae",
]
# A blank value means "this text names no company".
NAME_FIXES = {
    "a message from altair": "Altair",
    "joining the lam research talent community": "Lam Research",
    "3ds talent acquisition 3ds": "Dassault Systèmes",
    "ansys talent acquisition ansys job": "Ansys",
    "the recruiting team at meta": "Meta",
    "siemens p&o talent acquisition": "Siemens Energy",
    "apple worldwide recruiting": "Apple",
    "actalent actalent": "Actalent",
    "assa abloy candidate": "ASSA ABLOY",
    "lam": "Lam Research",
    "kla": "KLA",
    "lucidmotors": "Lucid Motors",
    "no-reply": "",
    "workable": "",
    "the sr": "",
}
LEADING_STRIPS = [
    r"^our\s+", r"^the\s+", r"^a message from\s+", r"^joining the\s+",
    r"^the recruiting team at\s+", r"^notification for\s+", r"^recent\s+",
    r"^human resources\s+", r"^workday[_ ]no.?reply\s+", r"^workday[_ ]notification[s]?\s+",
]
TRAILING_CUTS = [
    r"\s+talent acquisition.*$", r"\s+recruiting team.*$", r"\s+hiring team.*$",
    r"\s+worldwide recruiting.*$", r"\s+human resources.*$", r"\s+careers?.*$", r"\s+job$",
]
BLOCKED_COMPANIES = [
    "applytojob", "itsjnj", "jobgether", "lever", "one", "stand", "stand insurance", "",
]
SENDER_STOP_TOKENS = [
    "no", "reply", "noreply", "email", "autoreply", "notification", "notifications",
]
COMPANY_DOMAIN_OVERRIDES = {
    "Carnegie Mellon University": ["cmu.edu"],
    "Lawrence Livermore National Laboratory": ["llnl.gov"],
    "Oak Ridge National Laboratory": ["ornl.gov"],
    "Toyota Research Institute": ["tri.global"],
    "Zoox": ["zoox.com"],
}
CAREER_URL_OVERRIDES = {
    "Carnegie Mellon University": ["https://cmu.wd5.myworkdayjobs.com/CMU"],
    "Toyota Research Institute": ["https://www.tri.global/careers"],
    "Zoox": ["https://zoox.com/careers"],
}
WORKDAY_SENDER_DOMAINS = {"cmu": "cmu.edu", "llnl": "llnl.gov", "ornl": "ornl.gov", "lbl": "lbl.gov"}

# --- fixed values: boards ------------------------------------------------------------------
BOARD_HOSTS = {
    "greenhouse": ["boards.greenhouse.io", "job-boards.greenhouse.io"],
    "lever": ["jobs.lever.co"],
    "smartrecruiters": ["jobs.smartrecruiters.com", "api.smartrecruiters.com"],
    "workday": ["myworkdayjobs.com"],
    "icims": ["icims.com"],
    "jobvite": ["jobs.jobvite.com", "jobs-legacy.jobvite.com"],
    "teamtailor": ["teamtailor.com"],
    "ashby": ["jobs.ashbyhq.com"],
    "workable": ["apply.workable.com", "jobs.workable.com"],
    "successfactors": ["successfactors.com", "successfactors.eu", "sapsf.com"],
    "join": ["join.com"],
    "bamboohr": ["bamboohr.com"],
    "adp": ["adp.com"],
}
BOARD_URL_TEMPLATES = {
    "greenhouse": ["https://boards.greenhouse.io/{}", "https://job-boards.greenhouse.io/{}"],
    "lever": ["https://jobs.lever.co/{}"],
    "smartrecruiters": ["https://jobs.smartrecruiters.com/{}"],
    "icims": ["https://jobs-{}.icims.com/jobs/search?ss=1", "https://careers-{}.icims.com/jobs/search?ss=1"],
    "jobvite": ["https://jobs.jobvite.com/{}"],
    "teamtailor": ["https://{}.teamtailor.com/jobs"],
    "ashby": ["https://jobs.ashbyhq.com/{}"],
    "workable": ["https://apply.workable.com/{}"],
}
SEARCH_SITE_TEMPLATES = {
    "workday": 'site:myworkdayjobs.com "{}"',
    "greenhouse": 'site:greenhouse.io "{}" jobs',
    "lever": 'site:lever.co "{}" jobs',
    "smartrecruiters": 'site:smartrecruiters.com "{}" jobs',
    "icims": 'site:icims.com "{}" jobs',
    "jobvite": 'site:jobvite.com "{}" jobs',
    "teamtailor": 'site:teamtailor.com "{}" jobs',
    "ashby": 'site:ashbyhq.com "{}" jobs',
    "workable": 'site:workable.com "{}" jobs',
    "successfactors": 'site:successfactors.com "{}" jobs',
    "join": 'site:join.com "{}" jobs',
    "bamboohr": 'site:bamboohr.com "{}" jobs',
    "adp": 'site:adp.com "{}" jobs',
}
CAREER_PATHS = ["/careers", "/jobs", ""]
WORKDAY_PORTALS = [
    ("ORNL", "ornl.wd1.myworkdayjobs.com", "ORNL/OakRidge_Careers"),
    ("LBNL", "lbl.wd1.myworkdayjobs.com", "LBL/LBNL_Career"),
    ("NREL", "nrel.wd5.myworkdayjobs.com", "NREL/NREL"),
    ("ANL", "anl.wd1.myworkdayjobs.com", "ANL/argonne"),
    ("SLAC", "slac.wd1.myworkdayjobs.com", "SLAC/SLAC"),
    ("Sandia", "sandia.wd1.myworkdayjobs.com", "Sandia/Sandia_Careers"),
    ("BNL", "bnl.wd1.myworkdayjobs.com", "BNL/BNL_Careers"),
]
SEARCH_RESULT_BLOCKLIST = [
    "linkedin.com", "indeed.com", "glassdoor.com", "ziprecruiter.com", "jobspy", "greenhouse-mail.io",
]
SEARCH_RESULT_TOKENS = ["/careers", "/career", "/jobs", "/job", "/details/"]
ASSET_SUFFIXES = [".pdf", ".png", ".jpg", ".jpeg", ".svg", ".mp4", ".webm", ".gif"]
DOMAIN_ASSET_SUFFIXES = [".pdf", ".png", ".jpg", ".jpeg", ".svg"]
USEFUL_PATH_PARTS = ["/details/", "/search", "/jobs", "/job/", "/position", "/opening"]
USEFUL_PATHS = ["/career", "/careers", "/careers/us", "/careers/us/index"]
JOB_DETAIL_PARTS = ["/job/", "/jobs/", "/details/", "/opening/", "/position/"]
TRACKING_PARAMS = ["ref", "referer", "source"]
TRACKING_PREFIX = "utm_"

# --- fixed values: posting filters ------------------------------------------------------------
RESTRICTION_PHRASES = [
    "us citizen", "u.s. citizen", "united states citizen", "must be a citizen",
    "citizenship required", "citizenship is required", "only us citizens", "only u.s. citizens",
    "american citizen", "security clearance", "secret clearance", "top secret", "ts/sci", "ts sci",
    "dod clearance", "dod secret", "government clearance", "active clearance", "clearance required",
    "clearance eligible", "obtain a clearance", "hold a clearance", "itar", "itar restricted",
    "itar compliant", "itar requirements", "export control", "export controlled", "ear controlled",
    "permanent resident", "green card", "lawful permanent", "u.s. permanent",
]
NON_JOB_TITLE_STARTS = [
    "careers", "apply now", "find your perfect role", "join us", "posting locations",
    "total rewards", "prospective employee", "career resources", "living in",
    "statement of assurance", "temporary employment", "benefits",
]
NON_TARGET_TITLE_WORDS = [
    "hr", "human resources", "sales", "sourcing", "supply chain", "technician", "operator",
    "program manager", "director", "chief of staff", "intern",
]
ROLE_TOKENS = [
    "engineer", "scientist", "researcher", "developer", "analyst", "manager", "specialist",
]
SIGNAL_STOPWORDS = ["a", "an", "the", "and", "or", "for", "of", "in", "at", "to", "with", "by"]
ACADEMIC_TOPICS = [
    "research scientist", "staff scientist", "computational", "machine learning", "scientific",
    "mechanics",
]
HIGHER_ED_TOPICS = [
    "research scientist", "computational", "machine learning", "scientific", "mechanics",
]
US_STATE_TOKENS = [
    "al", "ak", "az", "ar", "ca", "co", "ct", "de", "fl", "ga", "hi", "id", "il", "in", "ia", "ks",
    "ky", "la", "me", "md", "ma", "mi", "mn", "ms", "mo", "mt", "ne", "nv", "nh", "nj", "nm", "ny",
    "nc", "nd", "oh", "ok", "or", "pa", "ri", "sc", "sd", "tn", "tx", "ut", "vt", "va", "wa", "wv",
    "wi", "wy", "dc",
]
NON_US_COUNTRY_TOKENS = [
    "au", "be", "br", "ca", "ch", "cn", "de", "dk", "es", "fr", "gb", "hk", "ie", "il", "in", "it",
    "jp", "kr", "mx", "my", "nl", "nz", "pl", "se", "sg", "th", "tr", "tw", "uk",
]

# --- fixed values: dates ------------------------------------------------------------------------
BLANK_DATES = ["", "nan", "none", "null"]
TODAY_WORDS = ["today", "just posted", "new"]
VISIBLE_DATE_PATTERNS = [
    r"posted on\s+(posted\s+\d+\+?\s+(?:hours?|days?|weeks?|months?)\s+ago)",
    r"posted\s+(\d+\+?\s+(?:hours?|days?|weeks?|months?)\s+ago)",
    r"date posted\s+([A-Z][a-z]+ \d{1,2}, \d{4})",
    r"posted on\s+([A-Z][a-z]+ \d{1,2}, \d{4})",
    r"posted on\s+(\d{4}-\d{2}-\d{2})",
]

# --- fixed values: run-log progress rules (any-of words, all-of words, low, high, message) --------
PROGRESS_RULES = [
    (["search", "scrape", "finished"], ["linkedin"], 10, 30, "Searching LinkedIn…"),
    (["indeed"], [], 30, 45, "Searching Indeed…"),
    (["glassdoor"], [], 45, 57, "Searching Glassdoor…"),
    (["ziprecruiter", "zip_recruiter"], [], 57, 65, "Searching ZipRecruiter…"),
    (["google"], [], 65, 72, "Searching Google Jobs…"),
    (["dedup", "duplicate"], [], 80, 80, "Removing duplicates…"),
    (["saving", "writing", ".csv"], [], 90, 90, "Saving results…"),
    (["scoring", "ai"], [], 95, 95, "Scoring with AI…"),
]

# --- fixed values: texts sent to a scoring model and to the user ------------------------------------
SCORE_PROMPT_HEAD = "Rate each job for this candidate (1–10) and give a one-sentence reason.\n\nCandidate profile:\n"
SCORE_PROMPT_TAIL = " lines:\nJOB 1: SCORE=X | REASON=...\nJOB 2: SCORE=X | REASON=...\netc."
SUGGEST_PROMPT = (
    "You are a job search expert helping this candidate find relevant jobs. "
    "suggest 15-20 specific job search keyword phrases.\n\nCandidate profile:\n{profile}\n\nAlready using:\n{existing}\n\n"
    "Focus on: job titles, tools/software, methodologies, and industries that match their background. "
    "Return ONLY a plain list, one phrase per line, no numbering, no explanations."
)
REVIEW_PROMPT_HEAD = "You are a job search expert. Review this keyword list and return a JSON object.\n\nKeywords:\n"
REVIEW_PROMPT_TAIL = (
    "\n\nReturn ONLY valid JSON, no markdown, no explanation:\n"
    "{\n"
    '  "quality_score": <1-10>,\n'
    '  "summary": "<2-sentence overall assessment>",\n'
    '  "weak": ["<vague or unlikely to return good results>"],\n'
    '  "redundant": [["<kw1>", "<kw2 that means the same>"]],\n'
    '  "suggestions": ["<5-10 strong keywords to add based on the profile>"]\n'
    "}"
)
COVER_LETTER_PROMPT = (
    "Write a concise, professional 3-paragraph cover letter.\n\nCandidate profile:\n{profile}\n\n"
    "Position: {title} at {institution}\nDescription:\n{description}\n\n"
    "Be specific. No generic filler. No placeholders like [Your Name]."
)
FIT_PROMPT = (
    "Analyze this job fit.\n\nCandidate:\n{profile}\n\nJob: {title} at {institution}\nDescription:\n{description}\n\n"
    "Give:\n- 3 bullets: GOOD fit reasons\n- 3 bullets: GAPS or concerns\n"
    "- Verdict: **Apply** / **Maybe** / **Skip** with one-line reason."
)
SCORE_BATCH, SCORED_JOBS, DEFAULT_SCORE = 10, 40, 5
UNPARSED_REASON, FAILED_REASON = "Could not parse", "Scoring error"

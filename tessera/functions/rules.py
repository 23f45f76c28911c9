"""Patterns that classification rules are made of.  Case is ignored unless a name says otherwise."""

# Titles, places and companies that the rules know, as regular expressions.
ROLE_HEAD = r"\b(sales|solutions?|support|field|service|customer|forward.?deployed|implementation|pre.?sales|partner|deployment|integration|technical account)\s+engineer\b"
WRONG_DISCIPLINE = r"\b(mechanical|electrical|civil|chemical|industrial|hardware|firmware|process|manufacturing|packaging|optical|rf|asic|analog|structural)\b"
SENIORITY_V1 = r"\b(staff|principal|distinguished|fellow|architect|director|vp|vice president|head of|manager|lead engineer|engineering lead)\b"
SENIORITY_V3 = r"\b(staff|principal|distinguished|fellow|architect|director|vp|vice president|head of|manager|lead engineer|engineering lead|lead software engineer|lead backend engineer|lead frontend engineer|lead full.?stack engineer|lead platform engineer|lead data engineer|lead machine learning engineer|lead ml engineer|lead ai engineer|lead security engineer|lead devops engineer)\b"
SWE_TITLE_V1 = r"\b(software engineer|software developer|backend|back.?end|frontend|front.?end|full.?stack|platform engineer|infrastructure engineer|systems engineer|distributed systems|site reliability|sre|devops|machine learning engineer|ml engineer|ai engineer|applied scientist|research engineer|data engineer|sde|swe|member of technical staff|web developer|application developer)\b"
SWE_TITLE_V2 = r"\b(software engineer|software developer|backend|back.?end|frontend|software development engineer|software dev engineer|front.?end|full.?stack|platform engineer|infrastructure engineer|systems engineer|distributed systems|site reliability|sre|devops|machine learning engineer|ml engineer|ai engineer|applied scientist|research engineer|data engineer|data scientist|sde|swe|member of technical staff|web developer|application developer|react engineer|react native engineer|ios engineer|android engineer|mobile engineer|qa automation engineer|security engineer|release engineer)\b"
TITLE_US_LOCATION = r"\b(United States|USA|Remote — US|Remote \(US\)|Remote US|Remote - US|Remote, US|US Remote|Remote from the US|Remote in the US|US-Remote)\b|, (AL|AK|AZ|AR|CA|CO|CT|DE|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|MT|NE|NV|NH|NJ|NM|NY|NC|ND|OH|OK|OR|PA|RI|SC|SD|TN|TX|UT|VT|VA|WA|WV|WI|WY|DC),?\s*(United States|USA|US)\b|\b(San Francisco|Seattle|New York|NYC|Chicago|Atlanta|Austin|Boston|Los Angeles|San Diego|San Jose|Mountain View|Palo Alto|Menlo Park|Redwood City|Sunnyvale|Bellevue|Denver|Boulder|Phoenix|Portland|Dallas|Houston|Arlington|Washington|Remote in the US|US-Remote)\b"
CLEARANCE_TITLE = r"\b(ts/sci|top secret|security clearance|polygraph|public trust|active clearance)\b"
EARLY_CAREER_V3 = r"\b(new grad|new graduate|entry|entry level|junior|intern)\b"
FEED_EXCLUDED_TITLE = r"\b(intern|internship|co-?op|apprentice|sales|account executive|analyst|supervisor|technician|facilities|administrator|product design|designer|support|customer|recruiter|senior|staff|principal|distinguished|director|vice president|\bvp\b|head of|manager|\blead\b|registered nurse|\bnurse\b|nursing|clinical)\b"
FEED_HIGH_LEVEL_TITLE = r"\b(?:engineer|developer|scientist|architect|programmer|sde)\s+(?:III|IV|V|[3-9])\b"
FEED_TECH_TITLE = r"\b(software|sde|developer|backend|frontend|front[- ]?end|full[- ]?stack|platform|infrastructure|site reliability|sre|devops|machine learning|ml|ai|data engineer|data scientist|data science|member of technical staff|mts|firmware|embedded|systems engineer|security engineer|cloud engineer|mobile engineer|ios engineer|android engineer)\b"
FEED_US_LOCATION = r"\b(United States|USA|US Remote|Remote US|Remote - US|Remote, US|Remote in the US|US-Remote|Remote - United States)\b|\b(California|Washington|New York|Texas|Massachusetts|Virginia|Colorado|Illinois|New Jersey|Michigan|Florida|Georgia|North Carolina|Oregon|Arizona|Ohio|Pennsylvania|Tennessee|Utah|Wisconsin|Minnesota|Missouri|Connecticut|Maryland|Indiana)\b"
FEED_NON_US_CODE = r"(?:^|[,/])(?:DE|FR|IT|ES|NL|IN|BR|AU|SG|JP|ZA|MX|GB|UK|TW|TWN|BRA|PL|RO|IE|VN|PH|NZ|CH|BE|AT|SE|NO|DK|FI|IL|AE|SA|TH|MY|ID|PK|BD|UA|TR|EG|NG|GH|MA|PE|CR)-"
FEED_NON_US_LOCATION = r"\b(United Kingdom|UK|England|Canada|Toronto|Vancouver|Poland|Romania|Spain|Barcelona|Italy|Milan|Torino|Brazil|Sao Paulo|São Paulo|Belo Horizonte|Nairobi|Kenya|Philippines|Taguig|Vietnam|Singapore|India|Bengaluru|Bangalore|Hyderabad|Pune|Mumbai|Chennai|Delhi|Noida|Gurugram|Gurgaon|Kolkata|Bhubaneswar|Prague|Czech|Qatar|Doha|Ireland|Dublin|Netherlands|Amsterdam|Germany|France|Paris|Mexico|Australia|Sydney|Taiwan|Taipei|Japan|Poland|South Africa|Argentina|Chile|Colombia|Portugal|Switzerland|Belgium|Austria|Sweden|Norway|Denmark|Finland|New Zealand|Israel|UAE|Dubai|Saudi Arabia|Thailand|Malaysia|Indonesia|Pakistan|Bangladesh|Ukraine|Turkey|Cairo|Egypt|Nigeria|Ghana|Morocco|Peru|Costa Rica|Brazil|TWN|BRA)\b"
FEED_ENTRY_TITLE = r"\b(new grad|new graduate|university grad|university graduate|college grad|recent grad|early career|entry[- ]level|graduate software|junior|software engineer\s*(i|1)\b|software development engineer\s*(i|1)\b|software developer\s*(i|1)\b|backend engineer\s*(i|1)\b|full[- ]?stack engineer\s*(i|1)\b|(?:ml|ai) engineer\s*(i|1)\b|sde\s*(i|1)\b|engineer\s*(i|1)\b|associate software engineer|member of technical staff|mts)\b"
FEED_DEFENSE_TITLE = r"\b(defense|missile|payload|radar|spacecraft|flight software|top secret|ts/sci|public trust)\b"
FEED_HARD_STOP = r"\b(itar|u\.s\. person|us person|security clearance|active clearance|top secret|ts/sci)\b"
TIER_1 = r"\b(google|alphabet|amazon|microsoft|meta|facebook|apple|nvidia|oracle|ibm|salesforce|adobe|intel|cisco|uber|airbnb|doordash|stripe|block|paypal|capitalone|capital one|jpmorgan|jp morgan|goldmansachs|goldman sachs|bankofamerica|bank of america|walmart|target|costco|homedepot|home depot|databricks|snowflake|servicenow|workday|atlassian|mongodb|cloudflare|coinbase|roblox|reddit|pinterest|lyft|instacart|twilio|splunk|doordashusa|robinhood|thenewyorktimes|new york times|esri|klaviyo)\b"
TIER_2 = r"\b(samsara|elastic|clear|idme|lightningai|rdccareers|zoominfo|abnormalsecurity|upstart|affirm|chime|mercury|fivetran|klaviyo|scaleai|grafanalabs|mozilla|backblaze|sezzle|oura|nexhealth|figma|notion|brex|gitlab|github|anthropic|openai|perplexity|linear|waymo)\b"
QUEUE_EARLY = r"\b(new grad|new graduate|early career|university grad|graduate|entry level|entry|junior|intern)\b"
QUEUE_JUNIOR_LEVEL = r"\b(sde\s*(i|1|ii|2)\b|software development engineer\s*(i|1|ii|2)?\b|software engineer\s*(i|1|ii|2)?\b|software developer\s*(i|1|ii|2)?\b)"
QUEUE_SENIOR = r"\b(senior|sr\.?|staff|principal|lead|manager|architect|director|head of|vp)\b"
QUEUE_DEFENSE = r"\b(itar|u\.s\. person|us person|security clearance|clearance|top secret|ts/sci|defense|missile|payload|classified|spacecraft|satellite|leo|radar|ew)\b"
QUEUE_DEFENSE_COMPANY = r"\b(anduril|spacex|rocketlab|trueanomaly|varda|archer|cesium|morse|questdefense|darkwolf|accenturefederal|freedomconsulting|systemstechnologyresearch|metrostarsystems|grvty|muonspace|rebuildmanufacturing)\b"
QUEUE_OUTREACH_COMPANY = r"\b(stripe|amazon|reddit|roblox|block|brex|pinterest|coinbase|gitlab|waymo|abnormalsecurity|elastic|clear|idme|lightningai|rdccareers|zoominfo|axon)\b"
QUEUE_REMOTE_US = r"\b(remote.*(us|usa|united states)|us[- ]remote)\b"
REQUIREMENT_TYPES = ["years", "education", "skill", "citizenship", "clearance", "authorization", "location", "residency"]
CONSEQUENTIAL = ["citizenship", "clearance", "authorization", "education", "years", "location", "residency"]
MANDATORY = r"\b(must|required|require[sd]?|mandatory|only|shall|need to be|minimum of|at least|does not offer|unable to sponsor|will not sponsor)\b"
MANDATORY_CONTEXT = r"\b(basic qualifications|required qualifications|minimum qualifications|requirements|what to bring|what you'll bring|you have)\b"
IMPLIED_MANDATORY = {
    "clearance": r"\b(eligible to obtain|eligibility to obtain|security clearance|secret|top secret|ts/sci)\b",
    "education": r"\b(ba/bs|bachelor'?s|b\.s\.|bs|master'?s|m\.s\.|ms|degree)\b",
    "years": r"\b\d+\+?\s*(?:years?|anos)\b",
    "location": r"\b(onsite|on-site|presencial|hybrid|remote|located in|based in)\b",
}
SOFTENER = r"\b(preferred|nice to have|a plus|ideally|desirable|bonus|not required|no[t]? necessary|familiarity)\b"
ROLE_FAMILIES = [
    ("qa", r"\b(qa|quality assurance|test automation)\b"), ("security", r"\b(security|application security|product security|appsec)\b"), ("data", r"\b(data scientist|analytics|business intelligence)\b"),
    ("ai_ml_infra", r"\b(machine learning|ml engineer|ai engineer|ai infra|model platform)\b"), ("developer_tools", r"\b(developer tools|dev tools|developer platform)\b"), ("platform", r"\b(devops|sre|site reliability|infrastructure|platform)\b"),
    ("fullstack", r"\b(full stack|fullstack|frontend|front end|react|next)\b"), ("backend", r"\b(backend|back end|api|distributed systems)\b"), ("software", r"\b(software engineer|software developer|swe|sde)\b"),
]
FAMILY_SCORES = {"backend": 3, "fullstack": 3, "ai_ml_infra": 3, "developer_tools": 3, "platform": 3, "software": 1, "data": -3, "qa": -3, "security": -3}
NEW_GRAD = r"\b(new grad|new graduate|university grad|college grad|entry[- ]level|early career|graduate software|software engineer i)\b"
SOFTWARE = r"\b(software|backend|frontend|full[- ]stack|platform|infrastructure|machine learning|ai|data engineer|robotics|embedded|systems)\b"
SPONSOR_YES = r"\b(visa sponsorship|sponsor(?:ship)? available|h-?1b|opt|cpt)\b"
SPONSOR_NO = r"\b(no sponsorship|does not sponsor|do not sponsor|unable to sponsor|will not sponsor|without sponsorship)\b"
SPONSOR_POINTS = {"yes": 25, "no": -40, "probable": 15}
WARNING_POINTS = {"green": 10, "yellow": 0, "orange": -15, "red": -35}
ALWAYS_INCLUDED = [
    "degree", "citizenship", "current_location", "education", "education:degree", "email", "employment", "experience", "full_name", "gpa", "graduate_gpa", "github", "linkedin", "phone", "portfolio", "professional_swe_years",
    "requires_sponsorship", "security_clearance", "us_person", "undergraduate_gpa", "willing_to_relocate", "work_authorization", "work_experience",
]
ALWAYS_INCLUDED_PREFIXES = ["education:", "employment:", "resume_metric_"]
NO_EXPERIENCE = r"\b(no (?:professional |prior |previous )?experience (?:is )?required|zero years? of (?:professional |relevant )?experience)\b"
YEARS_BEFORE_EXPERIENCE = r"\b(\d{1,2})(?:\s*(?:-|–|—|to)\s*(\d{1,2}))?\s*\+?\s*years?\b.{0,100}?\bexperience\b"
EXPERIENCE_BEFORE_YEARS = r"\bexperience\b.{0,100}?\b(\d{1,2})(?:\s*(?:-|–|—|to)\s*(\d{1,2}))?\s*\+?\s*years?\b"
YEARS_STATED = r"\b(\d{1,2})(?:\s*(?:-|–|—|to)\s*(\d{1,2}))?\s*\+?\s*years?\b.{0,100}?\bexperience\b|\bexperience\b.{0,100}?\b(\d{1,2})(?:\s*(?:-|–|—|to)\s*(\d{1,2}))?\s*\+?\s*years?\b"
OPEN_ENDED_TWO_PLUS = r"\b(?:(?:2|[3-9]|[1-9]\d)\s*\+\s*years?|(?:at least|minimum(?: of)?)\s+(?:2|[3-9]|[1-9]\d)\s+years?|(?:2|[3-9]|[1-9]\d)\s+years?\s+(?:or more|minimum))\b"
OPEN_BEFORE = r"\b(at least|minimum(?: of)?)\s*$"
OPEN_AFTER = r"^\s*(?:\+|or more\b|minimum\b)"
SALARY_RANGE = r"(\$\s?\d{2,3}(?:,\d{3})?(?:\s?[kK])?\s?(?:-|–|to)\s?\$?\s?\d{2,3}(?:,\d{3})?(?:\s?[kK])?)"
SALARY_RATE = r"(\$\s?\d{2,3}(?:,\d{3})?(?:\s?[kK])?\s?(?:/|per)\s?(?:year|yr|hour|hr))"
US_STATE_NAMES = r"\b(?:Alabama|Alaska|Arizona|Arkansas|California|Colorado|Connecticut|Delaware|Florida|Georgia|Hawaii|Idaho|Illinois|Indiana|Iowa|Kansas|Kentucky|Louisiana|Maine|Maryland|Massachusetts|Michigan|Minnesota|Mississippi|Missouri|Montana|Nebraska|Nevada|New Hampshire|New Jersey|New Mexico|New York|North Carolina|North Dakota|Ohio|Oklahoma|Oregon|Pennsylvania|Rhode Island|South Carolina|South Dakota|Tennessee|Texas|Utah|Vermont|Virginia|Washington|West Virginia|Wisconsin|Wyoming|District of Columbia)\b"
COMPANY_NAMES = {
    "capitalone": "Capital One", "bankofamerica": "Bank of America", "homedepot": "The Home Depot", "dxc technology": "DXC Technology", "dxc": "DXC Technology", "esri": "Esri", "t mobile": "T-Mobile",
    "newrelic": "New Relic", "purestorage": "Pure Storage", "analogdevices": "Analog Devices", "boozallenhamilton": "Booz Allen Hamilton", "state street": "State Street", "cloudflare": "Cloudflare",
}
RISKS = {
    "metric": r"\d+(\.\d+)?\s*(%|percent|x\b|ms\b|s\b|k\b|M\b|QPS|RPS)",
    "team_size": r"\b(team of|led|managed|mentored)\s+\d+",
    "ownership": r"\b(led|owned|architected|designed|spearheaded|drove|founded)\b",
    "scale": r"\b(million|billion|thousands of|at scale|in production|enterprise)\b",
    "duration": r"\b\d+\s*(year|month|week)s?\b",
}
FEED_DEFENSE_COMPANY = r"\b(anduril|spacex|rocketlab|trueanomaly|varda|cesiumastro|accenturefederalservices|darkwolf|freedomconsulting|systemstechnologyresearch|morsecorp|questdefense)\b"
PAGE_SENIOR_TITLE = r"\b(?:senior|sr\.?|staff|principal|distinguished|director|vice president|vp|head of|manager|lead)\b|\b(?:III|IV|V|[3-9])\b"
PAGE_NON_TECH_TITLE = r"\b(?:nurse|counsel|attorney|lawyer|unit coordinator|field service|technical content|content developer|product management|project manager|program manager|qa/?qc|reviewer|manufacturing process|packaging systems)\b"
PAGE_NEW_GRAD = r"\b(?:new\s+grad(?:uate)?|university\s+graduate)\b"
LEFTOVER_MARKUP = r"<[^>]+>|&(?:[a-zA-Z]+|#[0-9]+);"
CAREERS_TEMPLATES = ["https://{domain}/careers", "https://{domain}/jobs", "https://careers.{domain}", "https://jobs.{domain}", "https://www.{domain}/careers", "https://www.{domain}/jobs", "https://{domain}"]
SKILL_KEYS = ["skill", "skills", "technology", "technologies", "tool", "tools", "framework", "frameworks"]
ROLE_KEYS = ["preferred_role", "preferred_roles", "target_role", "target_roles"]
EDUCATION_KEYS = ["degree", "education"]
GATE_KEYS = [
    "authorization", "work_authorization", "requires_sponsorship", "citizenship", "us_person", "security_clearance", "clearance_eligible", "current_location", "location", "willing_to_relocate", "remote_preference",
    "preferred_domains", "avoid_domains",
]
STOP_WORDS = ["and", "or", "the", "in", "of", "a", "for", "to", "with", "at"]
GENERIC_TERMS = [
    "technical", "developed", "built", "integrated", "created", "using", "managed", "led", "improved", "improving", "supported", "maintained", "restructuring", "documentation", "automating", "workflows", "testing", "deployment", "program",
    "solutions", "operations", "systems", "responsible", "worked", "helped", "assisted", "various", "multiple", "ensured", "provided", "designed", "implemented", "collaborated",
]
BROAD_TITLE_TERMS = ["engineer", "developer", "scientist", "software", "systems"]

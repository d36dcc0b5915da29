"""Word lists, ranks and tables that results depend on, in their natural order."""

#: Publication statuses, lowest rank first.
STATUS_ORDER = ("work_in_progress", "working_paper", "reject_and_resubmit", "revise_and_resubmit", "accepted", "published")

#: Status changes worth an event.
TRANSITIONS = (
    ("working_paper", "revise_and_resubmit"), ("working_paper", "accepted"), ("working_paper", "published"),
    ("work_in_progress", "revise_and_resubmit"), ("work_in_progress", "accepted"), ("work_in_progress", "published"),
    ("revise_and_resubmit", "accepted"), ("revise_and_resubmit", "published"),
)
STALE_YEARS = 10

#: Departments of the "top 20" preset.
DEPARTMENTS = (
    "MIT", "Massachusetts Institute of Technology", "Harvard", "Princeton", "Stanford", "University of Chicago", "UC Berkeley", "University of California, Berkeley",
    "Columbia", "Yale", "Northwestern", "University of Pennsylvania", "New York University", "NYU", "Duke", "University of Michigan", "University of Minnesota", "Cornell",
    "UCLA", "University of California, Los Angeles", "UC San Diego", "University of California, San Diego", "University of Wisconsin", "Boston University", "Carnegie Mellon",
)

#: Journals of the "top 5" preset, and what only looks like one.
TOP5_JOURNALS = ("American Economic Review", "AER", "Econometrica", "Journal of Political Economy", "JPE", "Quarterly Journal of Economics", "QJE", "Review of Economic Studies", "REStud")
TOP5_EXCLUDED = ("European Journal of Political Economy",)

#: Phrases of page furniture, dropped before hashing.
BOILERPLATE = (
    "search this site", "embedded files", "skip to main content", "skip to navigation", "report abuse", "page details", "page updated",
    "this site uses cookies from google to deliver its services and to analyze traffic", "learn more got it", "accept all cookies", "reject all cookies",
)

#: Words on a title's end that tell its state.
TITLE_STATES = r"job\s+market\s+paper|jmp|working\s+paper|work\s+in\s+progress|under\s+review|submitted|forthcoming|accepted|draft|new(?:!)?|revised|updated|r\s*&\s*r"

#: Titles and parts of titles that are no publication's.
SITE_WORDS = ("cv", "feed", "email", "follow", "sitemap", "teaching", "publications", "papers", "research", "home", "contact", "about", "links", "news", "jmp", "bio", "vita")
SITE_PHRASES = ("no publications", "powered by", "welcome to my", "i will be on the job market", "i am a ", "i am an ", "my research interests", "site last updated", "academic webpage", "currently, i am")
SOFTWARE_PHRASES = ("python package", "r package", "npm package", "pip install", "github repository", "code repository", "open source software")
OVERLAP_STOPWORDS = ("a", "an", "the", "of", "on", "in", "and", "or", "for", "to", "at", "by", "is", "it", "as", "do", "no", "not", "with", "from", "but")
TITLE_STOPWORDS = ("the", "a", "an", "of", "on", "in", "at", "to", "for", "and", "or", "by", "with", "from", "as", "is", "are")
LINK_STOPWORDS = (
    "a", "an", "the", "of", "and", "in", "on", "to", "for", "is", "are", "was", "with", "by", "from", "or", "at", "as", "it", "its", "be",
    "do", "does", "did", "not", "no", "but", "if", "so", "can", "how",
)

#: Words that a full-text index leaves out.
INDEX_STOPWORDS = (
    "a", "about", "an", "are", "as", "at", "be", "by", "com", "de", "en", "for", "from", "how", "i", "in", "is", "it", "la", "of", "on", "or", "that", "the", "this", "to",
    "was", "what", "when", "where", "who", "will", "with", "und", "www",
)

#: Hosts whose links may be papers.
TRUSTED_DOMAINS = (
    "ssrn.com", "nber.org", "arxiv.org", "doi.org", "ideas.repec.org", "econpapers.repec.org", "econstor.eu", "cepr.org", "drive.google.com", "docs.google.com", "dropbox.com",
    "files.cargocollective.com", "aeaweb.org", "academic.oup.com", "journals.uchicago.edu", "onlinelibrary.wiley.com", "sciencedirect.com", "link.springer.com", "rdcu.be",
    "tandfonline.com", "taylorfrancis.com", "jstor.org", "cambridge.org", "degruyterbrill.com", "degruyter.com", "annualreviews.org", "journals.sagepub.com", "mohrsiebeck.com",
    "muse.jhu.edu", "izajoels.com", "direct.mit.edu", "econometricsociety.org", "restud.com", "iza.org", "diw.de", "ifo.de", "cesifo-group.de",
)
#: Hosts on which each page has an owner of its own.
SHARED_HOSTS = (
    "sites.google.com", "github.io", "wordpress.com", "weebly.com", "wixsite.com", "blogspot.com", "squarespace.com", "netlify.app", "vercel.app", "github.com",
)
#: Hosts of many people's sites, and marks of an institution's host.
TENANT_HOSTS = ("sites.google.com", "github.io", "wixsite.com", "wordpress.com", "weebly.com", "squarespace.com", "netlify.app", "vercel.app", "web.mit.edu", "campuspress.yale.edu")
INSTITUTION_MARKS = (
    ".edu", ".ac.uk", ".ac.at", ".ac.jp", ".ac.nz", ".ac.za", "university", "univ.", "uni-", ".uni.", "bundesbank", "ecb.europa", "bankofcanada", "newyorkfed", "chicagofed", "repec.org", "tse-fr.", "nber.org",
)
#: Pages that list papers, by the last step of their path or the text of a link; endings of files.
RESEARCH_LEAF = r"(?i)/(?:research(?:[-_]?papers?)?|publications?|papers?|working[-_]?papers?|work[-_]?in[-_]?progress|selected[-_]?papers?|writings?)(?:\.html?)?/*$"
RESEARCH_ANCHOR = r"(?i)^(?:research|publications?|papers?|working\s+papers?|work\s+in\s+progress|selected\s+papers?|my\s+(?:research|papers?|publications?)|research\s+(?:papers?|output|page)|published\s+(?:papers?|work))$"
FILE_ENDINGS = r"(?i)\.(?:pdf|zip|gz|doc|docx|ps|bib|tex|csv|xlsx?|pptx?|png|jpg|jpeg|gif|svg)$"
NON_ARTICLE_PATHS = ("/topics/", "/about/", "/help/", "/search", "/browse/", "/login", "/register", "/cart", "/account")
REPOSITORY_HOSTS = ("repec.org", "econstor.eu", "cepr.org", "iza.org", "diw.de", "ifo.de", "cesifo-group.de")
GENERIC_ANCHOR = (
    r"(?i)^(ssrn\s*(version)?|nber\s*working\s*paper|working\s*paper|paper|pdf|draft|download|link|preprint|manuscript|published\s*version|journal\s*version|"
    r"accepted\s*version|online\s*appendix|appendix|code|replication|data|slides|presentation|abstract|bibtex|citation)$"
)

#: Elements inside a line, elements that are a block of text, and those that are page furniture.
INLINE_TAGS = ("span", "em", "strong", "b", "i", "u", "small", "sub", "sup", "img", "br", "wbr", "mark", "abbr", "code")
BLOCK_TAGS = ("p", "li", "dd", "td", "th", "blockquote", "figcaption")
FURNITURE_TAGS = ("script", "style", "nav", "header", "footer", "aside")
#: What follows a title in its block, in the order in which it is looked for.
LABEL_MARKERS = (
    "[ Abstract", "[Abstract", "[ Draft", "[Draft", "[ PDF", "[PDF", "[ SSRN", "[SSRN", "[ NBER", "[NBER", "[ Link", "[Link", "[ Working Paper", "[Working Paper",
)

#: Words in which only one of two titles of distinct papers may differ.
DISTINCT_MARKERS = r"[0-9]|^(i|ii|iii|iv|v|comment|reply|rejoinder|appendix|corrigendum|erratum|part|revisited|extension|update|updated)$"

#: Topic keywords, more specific ones first, with the codes of the classification they stand for.
TOPIC_CODES = (
    ("labor market", ("J",)), ("labour market", ("J",)), ("wage", ("J",)), ("employment effect", ("J",)), ("unemployment", ("J",)), ("immigration", ("J",)), ("demographic", ("J",)), ("fertility", ("J",)), ("pension", ("J", "H")), ("human capital", ("J", "I")),
    ("international trade", ("F",)), ("trade and", ("F",)), ("trade flow", ("F",)), ("exchange rate", ("F",)), ("globalization", ("F",)), ("migration", ("J", "F")), ("foreign direct investment", ("F",)),
    ("monetary policy", ("E",)), ("inflation", ("E",)), ("central bank", ("E",)), ("macroeconomic", ("E",)), ("business cycle", ("E",)), ("interest rate", ("E",)),
    ("financial market", ("G",)), ("banking", ("G",)), ("stock market", ("G",)), ("asset pricing", ("G",)), ("corporate finance", ("G",)), ("credit risk", ("G",)), ("insurance market", ("G",)), ("portfolio", ("G",)),
    ("tax", ("H",)), ("public finance", ("H",)), ("public good", ("H",)), ("government spending", ("H",)), ("fiscal policy", ("E", "H")), ("public debt", ("H", "E")),
    ("health economics", ("I",)), ("education", ("I",)), ("welfare", ("I",)), ("poverty", ("I", "O")), ("health care", ("I",)), ("schooling", ("I",)),
    ("economic development", ("O",)), ("economic growth", ("O",)), ("innovation", ("O",)), ("technological change", ("O",)), ("technology adoption", ("O",)), ("entrepreneurship", ("L", "O")),
    ("behavioral economics", ("D",)), ("consumer", ("D",)), ("household decision", ("D",)), ("auction", ("D",)), ("inequality", ("D", "I")), ("game theory", ("C", "D")),
    ("industrial organization", ("L",)), ("firm", ("L",)), ("market structure", ("L",)), ("competition", ("L",)), ("antitrust", ("L", "K")), ("market power", ("L",)),
    ("econometric", ("C",)), ("experimental economics", ("C",)), ("statistical", ("C",)), ("causal inference", ("C",)),
    ("environmental", ("Q",)), ("agricultural", ("Q",)), ("natural resource", ("Q",)), ("climate", ("Q",)), ("energy", ("Q",)),
    ("urban", ("R",)), ("housing", ("R",)), ("regional", ("R",)), ("transportation", ("R",)), ("real estate", ("R",)),
    ("law and economics", ("K",)), ("crime", ("K",)), ("regulation", ("K", "L")), ("legal", ("K",)), ("economic history", ("N",)), ("historical", ("N",)),
    ("political economy", ("P", "H")), ("economic system", ("P",)), ("marketing", ("M",)), ("accounting", ("M",)), ("management", ("M",)),
)

#: Venue texts that are a state and no venue.
STATE_VENUES = ("working paper", "draft", "under review", "submitted", "r&r", "revise and resubmit", "reject and resubmit", "work in progress", "job market paper", "jmp")

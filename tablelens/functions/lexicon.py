"""English word rules as data: ``(category, key, value)``.

The tables are fixed values. Of the irregular verbs the regular forms are listed too.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

CATEGORIES = (
    "abbreviations", "irregular_verbs", "irregular_nouns", "irregular_adjectives", "spelling_variants", "compound_nouns", "no_strip",
)

# fixed values: forms of irregular verbs, "form=base", those in -s and -ing included
VERBS = """
am=be is=be are=be was=be were=be been=be being=be has=have had=have haves=have having=have did=do done=do does=do
doing=do went=go gone=go goes=go going=go said=say says=say saying=say got=get gotten=get gets=get getting=get made=make
makes=make making=make knew=know known=know knows=know knowing=know thought=think thinks=think thinking=think took=take
taken=take takes=take taking=take saw=see seen=see sees=see seeing=see came=come comes=come coming=come gave=give
given=give gives=give giving=give found=find finds=find finding=find told=tell tells=tell telling=tell became=become
becomes=become becoming=become left=leave leaves=leave leaving=leave felt=feel feels=feel feeling=feel puts=put
putting=put brought=bring brings=bring bringing=bring began=begin begun=begin begins=begin beginning=begin kept=keep
keeps=keep keeping=keep held=hold holds=hold holding=hold wrote=write written=write writes=write writing=write
stood=stand stands=stand standing=stand heard=hear hears=hear hearing=hear lets=let letting=let meant=mean means=mean
meaning=mean sets=set setting=set met=meet meets=meet meeting=meet ran=run runs=run running=run paid=pay pays=pay
paying=pay sat=sit sits=sit sitting=sit spoke=speak spoken=speak speaks=speak speaking=speak lay=lie lain=lie lies=lie
lying=lie led=lead leads=lead leading=lead reads=read reading=read grew=grow grown=grow grows=grow growing=grow
lost=lose loses=lose losing=lose fell=fall fallen=fall falls=fall falling=fall sent=send sends=send sending=send
built=build builds=build building=build understood=understand understands=understand understanding=understand drew=draw
drawn=draw draws=draw drawing=draw broke=break broken=break breaks=break breaking=break spent=spend spends=spend
spending=spend cuts=cut cutting=cut caught=catch catches=catch catching=catch drove=drive driven=drive drives=drive
driving=drive bought=buy buys=buy buying=buy wore=wear worn=wear wears=wear wearing=wear chose=choose chosen=choose
chooses=choose choosing=choose sought=seek seeks=seek seeking=seek threw=throw thrown=throw throws=throw throwing=throw
taught=teach teaches=teach teaching=teach dealt=deal deals=deal dealing=deal showed=show shown=show shows=show
showing=show rose=rise risen=rise rises=rise rising=rise fought=fight fights=fight fighting=fight hits=hit hitting=hit
sang=sing sung=sing sings=sing singing=sing swam=swim swum=swim swims=swim swimming=swim flew=fly flown=fly flies=fly
flying=fly ate=eat eaten=eat eats=eat eating=eat drank=drink drunk=drink drinks=drink drinking=drink slept=sleep
sleeps=sleep sleeping=sleep woke=wake woken=wake wakes=wake waking=wake sold=sell sells=sell selling=sell won=win
wins=win winning=win rode=ride ridden=ride rides=ride riding=ride shook=shake shaken=shake shakes=shake shaking=shake
forgot=forget forgotten=forget forgets=forget forgetting=forget blew=blow blown=blow blows=blow blowing=blow hung=hang
hangs=hang hanging=hang stole=steal stolen=steal steals=steal stealing=steal hid=hide hidden=hide hides=hide hiding=hide
bit=bite bitten=bite bites=bite biting=bite tore=tear torn=tear tears=tear tearing=tear fed=feed feeds=feed feeding=feed
dug=dig digs=dig digging=dig spreads=spread spreading=spread shuts=shut shutting=shut costs=cost costing=cost quits=quit
quitting=quit hurts=hurt hurting=hurt laid=lay lays=lay laying=lay lit=light lights=light lighting=light shot=shoot
shoots=shoot shooting=shoot froze=freeze frozen=freeze freezes=freeze freezing=freeze forbade=forbid forbidden=forbid
forbids=forbid forbidding=forbid forgave=forgive forgiven=forgive forgives=forgive forgiving=forgive swore=swear
sworn=swear swears=swear swearing=swear overcame=overcome overcomes=overcome overcoming=overcome undertook=undertake
undertaken=undertake undertakes=undertake undertaking=undertake withdrew=withdraw withdrawn=withdraw withdraws=withdraw
withdrawing=withdraw used=use uses=use using=use
"""

# fixed values: irregular noun forms, "form=singular"
NOUNS = """
men=man women=woman children=child teeth=tooth feet=foot mice=mouse geese=goose oxen=ox people=person dice=die
lives=life wives=wife knives=knife halves=half selves=self shelves=shelf wolves=wolf thieves=thief loaves=loaf
leaves=leaf calves=calf scarves=scarf
childrens=child womens=woman mens=man teeths=tooth feets=foot mices=mouse geeses=goose oxens=ox peoples=person
phenomena=phenomenon criteria=criterion analyses=analysis bases=basis crises=crisis theses=thesis
hypotheses=hypothesis diagnoses=diagnosis oases=oasis parentheses=parenthesis syntheses=synthesis
alumni=alumnus fungi=fungus cacti=cactus nuclei=nucleus syllabi=syllabus stimuli=stimulus
data=datum media=medium bacteria=bacterium curricula=curriculum memoranda=memorandum
indices=index appendices=appendix matrices=matrix vertices=vertex axes=axis
"""

# fixed values: irregular comparatives and superlatives
ADJECTIVES = """
better=good best=good worse=bad worst=bad more=many most=many less=little least=little
further=far furthest=far farther=far farthest=far elder=old eldest=old older=old oldest=old
"""

# fixed values: abbreviations and their full forms
ABBREVIATIONS = """
ad=advertisement
ai=artificial intelligence
app=application
bike=bicycle
exam=examination
fridge=refrigerator
gym=gymnasium
kilo=kilogram
lab=laboratory
maths=mathematics
pe=physical education
photo=photograph
tv=television
pc=personal computer
uk=united kingdom
us=united states
usa=united states
diy=do it yourself
vip=very important person
id=identification
iq=intelligence quotient
ok=okay
asap=as soon as possible
etc=et cetera
vs=versus
dna=deoxyribonucleic acid
gps=global positioning system
wifi=wireless fidelity
atm=automated teller machine
ceo=chief executive officer
fyi=for your information
ufo=unidentified flying object
"""

# fixed values: spelling variants, "primary: variant ..."
VARIANTS = """
apologise: apologize apologizes apologized apologizing
criticise: criticize criticizes criticized criticizing
organise: organize organizes organized organizing
recognise: recognize recognizes recognized recognizing
realise: realize realizes realized realizing
practice: practise practises practised practising
colour: color colors colored coloring
favour: favor favors favored favoring
favourite: favorite favorites
flavour: flavor flavors flavored flavoring
honour: honor honors honored honoring
humour: humor humors humored humoring
labour: labor labors labored laboring
neighbour: neighbor neighbors
neighbourhood: neighborhood
centre: center centers centered centering
metre: meter meters
theatre: theater theaters
kilometre: kilometer kilometers
centimetre: centimeter centimeters
millimetre: millimeter millimeters
dialogue: dialog dialogs
civilisation: civilization civilizations
organisation: organization organizations
analyse: analyze analyzes analyzed analyzing
gramme: gram grams
programme: program programs
grey: gray
disc: disk disks
towards: toward
per cent: percent
until: till
maths: math
"""

# fixed values: compound nouns and set phrases
COMPOUNDS = """
mobile phone
ice cream
kung fu
due to
ought to
high school
primary school
middle school
living room
dining room
post office
bus stop
credit card
first aid
traffic light
solar system
global warming
social media
climate change
human being
remote control
text message
roller coaster
science fiction
blood pressure
junk food
fast food
theme park
car park
parking lot
department store
shopping mall
swimming pool
washing machine
air conditioning
traffic jam
rush hour
good morning
good afternoon
good evening
good night
"""

# fixed values: words that only look inflected
PROTECTED = """
thing nothing something anything everything king ring sing wing bring string spring swing sting cling fling sling wring
morning evening during ceiling feeling being seeing offering suffering engineering
water weather whether other another mother father brother sister after under over never ever together however
whatever whenever wherever whoever power flower tower shower cover discover recover number member remember november
december september october computer center letter matter dinner summer winter inner manner order border corner finger
danger anger hunger wonder thunder paper proper super silver river liver fever clever offer differ suffer butter litter
bitter trigger consider answer master monster chapter character minister disaster teacher worker player leader reader
speaker writer driver singer manager officer soldier stranger passenger customer volunteer producer consumer researcher
designer engineer pioneer traveler newcomer performer reporter observer employer container beer deer career steer tiger
ginger gender tender render slender enter counter encounter foster poster register either neither rather gather feather
leather heather
bed red fed led shed sled wed need seed feed speed indeed proceed hundred sacred wicked naked hatred
yes series species
test rest best west nest quest forest interest suggest protest request harvest honest modest
utter upper outer her his its per the are were ore
"""

# fixed values: nouns that end in -ie and take a plain -s
IE_WORDS = """
cookie brownie calorie collie zombie birdie pixie magpie sortie prairie boogie movie smoothie beanie genie goalie hoodie
junkie pinkie rookie selfie veggie caddie dearie eerie foodie groupie hippie lassie meanie mountie nappie oldie pie
reverie roomie sweetie techie yuppie auntie brie die lie tie vie
""".split()

_C = "bcdfghjklmnpqrstvwxyz"
# fixed values: suffix rules (pattern, replacement); the first match gives the lemma. A stem keeps
# three letters; a doubled final consonant is undoubled except s, l, f, z.
SUFFIX_RULES = (
    (rf"^(.{{2,}}([slfz])\2)ing$", "$1"),
    (rf"^(.{{2,}}([{_C}]))\2ing$", "$1"),
    (rf"^(.+[{_C}][{_C}]|..+[ynrwl])ing$", "$1"),
    (rf"^(.+[aeiou][{_C}])ing$", "$1e"),
    (r"^(.{3,})ing$", "$1"),
    (r"^(.{3,})ied$", "$1y"),
    (rf"^(.{{2,}}([slfz])\2)ed$", "$1"),
    (rf"^(.{{2,}}([{_C}]))\2ed$", "$1"),
    (rf"^(.+[{_C}][cg]|.+[nrl]s)ed$", "$1e"),
    (rf"^(.+[{_C}][{_C}]|.+[aeiou][nrlwyx])ed$", "$1"),
    (rf"^(.+[aeiou][{_C}])ed$", "$1e"),
    (r"^(.{3,})ed$", "$1"),
    (rf"^({'|'.join(w for w in IE_WORDS if len(w) > 4)})s$", "$1"),
    (r"^(.{3,})ies$", "$1y"),
    (r"^(.{3,})ves$", "$1fe"),
    (r"^(.+(?:sh|ch|ss)|..+[xz])es$", "$1"),
    (r"^(.{3,}o)es$", "$1"),
    (r"^(.{3,}e)s$", "$1"),
    (r"^(.{2,}[^s])s$", "$1"),
    (r"^(.{3,})ier$", "$1y"),
    (rf"^(.{{2,}}([{_C}]))\2er$", "$1"),
    (r"^(.{3,})iest$", "$1y"),
    (rf"^(.{{2,}}([{_C}]))\2est$", "$1"),
)


def _pairs(text: str) -> dict[str, str]:
    return dict(part.split("=", 1) for part in text.split())


def _lines(text: str) -> list[str]:
    return [line for line in text.strip().splitlines() if line]


def built_in_rules() -> list[tuple[str, str, str]]:
    rules = [("abbreviations", *line.split("=", 1)) for line in _lines(ABBREVIATIONS)]
    rules += [("irregular_verbs", k, v) for k, v in _pairs(VERBS).items()]
    rules += [("irregular_nouns", k, v) for k, v in _pairs(NOUNS).items()]
    rules += [("irregular_adjectives", k, v) for k, v in _pairs(ADJECTIVES).items()]
    for line in _lines(VARIANTS):
        primary, variants = line.split(": ")
        rules += [("spelling_variants", v, primary) for v in variants.split()]
    rules += [("compound_nouns", p, p) for p in _lines(COMPOUNDS)]
    rules += [("no_strip", w, w) for w in PROTECTED.split()]
    return [(c, k, v) for c, k, v in rules]


def rules_frame(spark: SparkSession, rules: Iterable[tuple[str, str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(list(built_in_rules() if rules is None else rules), "category string, key string, value string")

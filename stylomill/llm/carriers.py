"""The labelled table's sentences, made up here: carriers of details, and sentences that only look like some.

Slots: {E} email, {P} phone, {I} identity number, {A} address, {N} a person's name; all others are filled without a label:
{M} a name that something else bears, {L} words of another language, {F}, {f} given name, {T} town, {G} organisation, {R} street name, {K} street with its kind, {h} handle,
{B} what a number of things is called, {Z} such a number, {c} noun, {v} past verb, {a} adjective, {y} adverb, {w} day or month, {k} number, {X} capitals, {d3} three digits.
"""

from __future__ import annotations

EMAIL = """
Please forward the minutes to {E} before lunch.
{E} is printed on the poster by the gym door.
Send your entries, with a sketch, to {E}.
The landlord only answers at {E}, and {y}.
For refunds try {E} first.
Bids must reach {E} by {w}.
She signed up as {E} and forgot about it.
Anyone with a spare {c} can mail {E}.
Her work account is {E} and the private one is {E}
cc: {E}
From: {E}
Reply-To: {E}
e-mail: {E}
Email - {E}
mail me at {E} if the {c} turns up
Volunteers: {E}
His inbox ({E}) was full.
[{E}]
ask {E}; they know the {c}.
my new one is {E}, thanks
Queries about the {c} go to {E} and nobody else.
The {c} was {v} from {E} on {w}.
We {v} a note to {E}. No reply.
Lost keys? {E}
RSVP {E} by {w}!
A {a} reader, {E}, {v} the picture.
Somebody using {E} {v} the {c} {y}.
contact {E}
Photos: {E} / no calls
Pitch us ({E}) your {a} {c}
The account behind it, <{E}>, was {v}.
You may also write to {E}.
bookings at {E} until {w}
Nothing sent to {E} ever {v} back
{E} {v} the {c} twice.
The {G} can be reached through {E}.
Or just use {E} like everyone
Complaints, as before, to: {E}.
"""
PHONE = """
Leave a message on {P} after {d1} pm.
{P} rings at the {c} desk.
The {c} gave {P} as a contact.
She can be phoned on {P} most evenings.
Our new line is {P}, open until {w}.
If you find the {c}, ring {P}.
Text the word {a} to {P} and wait.
Phone: {P}
Tel {P}
Telephone - {P}
Cell: {P}
mobile {P}
fax {P}
call me {P}
Dial {P} for the {c}.
WhatsApp: {P}
Emergencies only: {P}
The {c} helpline, {P}, was {v} on {w}.
his number is {P} now
He scribbled {P} on the {c}.
Someone kept calling from {P}.
Missed call, {P}, {d2}:{d2}
Reach the {G} on {P} or in person.
Bookings ({P}) close on {w}.
Her mobile ({P}) was {v}.
A {a} voice on {P} said the {c} was {v}.
you could try {P}, or {P} at night
SMS {P}
Office {P}, ask for the {c}
They {v} {P} and nobody answered
Numbers to keep: {P}
h: {P}
w: {P}
Taxi? {P}
It was listed under {P} for years.
Anyone who {v} the {c} can contact the {G} on {P}.
pls call {P}!!
"""
ID = """
ID: {I}
ID number {I}
His ID is {I}.
passport {I}
Passport No: {I}
Her passport ({I}) expires in {w}.
National insurance number {I}
NI no. {I}
SSN {I}
SSN: {I}
social security {I}
Social Security number: {I}.
The {c} showed the identity card {I} to everyone.
tax number {I}
Taxpayer ID {I}
A scan of passport {I} was {v}.
The form asked for a national ID; {I} was {v} there.
Whoever {v} it wrote {I} as the identity number.
Anyone could read the social security number, {I}, from the {c}.
identity no. {I} was {v} {y}
A driving licence, {I}, lay under the {c}.
The clerk {v} the passport {I} on {w}.
He lost a passport, number {I}, near {T}.
her national insurance number is {I} and not secret any more
The {c} {v} ID number {I} aloud.
document {I}, issued to the tenant
Identity: {I}
Their file holds the tax ID ({I}) as well.
Using the identity number {I}, somebody {v} a loan.
The card had {I} under the photo.
Visa and passport ({I}, {I}) were {v}.
My SSN, {I}, was on the {c}.
It listed {I} beside the photo.
{I} belongs to the tenant of the {c}.
the file has {I} for her and {I} for him
Her papers, {I}, were {v}.
Registered as {I} since {w}.
A citizen with {I} on the card {v} the {c}.
{I}
Employee record: {I}, {d2} years old.
She read out {I} {y}.
They {v} his papers ({I}) on {w}.
"""
ADDRESS = """
The {c} is kept at {A}.
Bring the {a} {c} to {A} on {w}.
Her aunt lives at {A}.
A fire broke out at {A} in {T}.
{A} was sold {y}.
The tenant of {A} {v} the {c}.
Address: {A}
Addr. {A}
Home: {A}
Ship to: {A}
Return to {A}
Office: {A}, {T}
We moved from {A} to {A}.
Parcel left at {A}, behind the {c}.
The sale is at {A}, {T}, from {w}.
Neighbours of {A} {v} about the {c}.
Come to {A} for tea
an inspection at {A} found a {a} {c}
Officers {v} a {c} in {A} on {w}.
Thieves entered {A} through a window.
I grew up at {A}, next to the {c}.
Viewing of {A} by appointment
({A})
Meet me by {A} at {d1}
Post the {c} to {A}, {T}.
It belongs to the owners of {A}, {T}. They {v} it.
From {A} one can see the {c}.
somewhere around {A} I lost my {c}
His last known address, {A}, was empty.
party at {A}!!
They gave {A} as their home.
{A}, {T}
The {G} {v} {A} to let a {c} through.
Deliveries for {A} go to the back.
"""
NAME = """
{N} {v} the {c} on {w}.
{N} was {y} {v}.
{N} and {N} {v} a {c} together.
{N} has {v} the {a} {c}.
{N} did not reply.
{N} will appear before the court in {w}.
{N}, who owns the {c}, {v} it.
{N}, {d2}, from {T}, {v} the {c}.
{N}, a {a} {c} from {T}, {v} it.
{N} of {T} {v} the {c}
{N} 's {c} was {v}.
{N}’s {c} was {v} {y}.
{N} - {c}
{N}: the {c} is {a}.
The {c} was {v} by {N} on {w}.
It was {v} by {N}.
The {c} belongs to {N}.
The {c} of {N} was {v}.
We met {N} at the {c}.
I saw {N} near {T}.
They thanked {N} {y}.
She married {N} in {w}.
The court fined {N} for a {a} {c}.
Her neighbour {N} {v} the {c}.
His brother {N} {v} {y}.
Their son, {N}, is {d2}.
my aunt {N} {v} me a {c}
My old teacher {N} retired.
Our plumber {N} {v} the {c}.
A man called {N} {v} the {c}.
A tenant, {N}, {v} that the {c} was {a}.
The owner, {N}, was {v}.
A spokesman, {N}, {v} the {c}.
Its chair {N} {v} the {a} {c}.
chief executive {N} {v}
Mayor {N} {v} the {c}.
Coach {N} {v} the team.
Judge {N} {v} it.
Officer {N} {v} the {c} {y}.
Mr {N} {v} the {c}.
Mr. {N} {v} it.
Mrs {N} was {v}.
Ms {N} left {y}.
Miss {N} {v} the {c}.
Dr {N} {v} the {c}.
Dr. {N} of the {G} {v} it.
Prof. {N} {v} a {c}.
Professor {N} {v} it.
Sir {N} {v} the {c}.
Captain {N} {v} the {c}.
“The {c} is {a},” {N} said.
“The {c} is {a},” said {N}.
"It was {a}," according to {N}, "and {y} {v}."
“We {v} it.” {N} {v} the {c}.
told {N} that the {c} was {a}
asked {N} about the {c}
{N} told the {G} about it.
{N} from the {G} {v} the {c}.
The {G} {v} {N} in {w}.
In {T}, {N} {v} the {c}.
On {w}, {N} {v} a {c}.
After the {c}, {N} and the {G} {v}.
At the {c} we talked to {N}, {N} and {N}.
with {N}
by {N}
By {N}
Photo: {N}
Text: {N}
Name: {N}
Owner: {N}
Patient: {N}
Contact: {N}
Attention: {N}
For: {N}
To: {N}
Dear {N},
Hi {N}
Hello {N}!
Yours, {N}
Best, {N}
Regards, {N}
Signed {N}
- {N}
({N})
{N}
shout-out to {N} for the lift!
so proud of {N} today
congrats {N}!!
RIP {N}
thank you {N}
great talk by {N} at the {c}
who is {N}?
Who knows {N}?
Have you seen {N}? Last seen in {T}.
The police named {N} as a witness.
Two people, {N} and {N}, were {v}.
The {c} had been booked under {N}.
Letters to {N} were {v} {y}.
The note, from {N}, was {a}.
A {c} for {N} was left at the {c}.
The account in the name of {N} was {v}.
The child of {N} {v} a {c}.
The suspect, whom neighbours know as {N}, {v}.
The dentist {N} {v} the {c}.
and then {N} {v} it.
but {N} {v} no {c}.
because {N} {v} the {c} {y}
The {c} went to {N}; the {c} to {N}.
Nobody {v} {N} before.
Reporters talked to {N} and {d1} neighbours.
{N} told {N} everything.
We asked {N}, but {N} said no.
They saw {N}, and {N} {v} it.
First {N}, then {N} {v} the {c}.
Detectives spoke to {N} and one other {c}.
Staff later helped {N} and three others.
Nurses listened to {N} for an hour.
Somebody explained it to {N} and left.
It was said to {N} and two more.
Police want to hear from {N} again.
We spoke with {N} and a {c}.
The {c} was sent to {N} and the {G}.
A friend wrote to {N} and {v}.
The keys were given to {N} and {v}.
Yesterday {N} {v} the {c}.
Later {N} {v} it.
Meanwhile {N} {v} a {a} {c}.
"""
#: Parts that stand in lines, cells and signatures.
CELLS = ["{N}", "{N}", "{A}", "{P}", "{E}", "{I}", "Name: {N}", "Tel: {P}", "tel. {P}", "Mob {P}", "Phone: {P}", "E-mail: {E}", "email {E}", "Addr: {A}", "Address: {A}", "ID: {I}", "ID {I}", "SSN {I}", "Passport {I}", "NI {I}", "attn {N}", "Attn. {N}", "c/o {N}", "to {N}", "{P} (home)", "{N}, {A}", "{A}, {T}", "{N} {P}"]

NUMBERS = """
Order {X}{d6} is on its way.
Your order no. {d8} was {v}.
Order #{d7}
Invoice {d4}-{d4} is due on {w}.
ISBN {d3}-{d1}-{d4}-{d4}-{d1}
ISBN-10: {d1}-{d3}-{d5}-{d1}
ISSN {d4}-{d4}
The serial number {X}{d7} is under the {c}.
Serial no. {d4}-{d4}-{d4}
Batch {d6} was {v} {y}.
Flight {X}{d3} to {T} was {v}.
Flight {X} {d4}, gate {d2}
Train {d4} leaves at {d2}:{d2}.
Bus {d3} no longer goes to {T}.
Ticket {d3}-{d3}-{d3} won the {c}.
Ticket number {X}-{d6}
Case {d2}/{d4} is before the court.
Case no. {d4}-{d3}
Version {d1}.{d2}.{d3}
build {d4}.{d4}
Release {d1}.{d1} of the {c}
Model {X}-{d3} is {a}.
part number {d5}-{d3}
Article {d6}{d4}
SKU {d8}
tracking {d4} {d4} {d4}
Parcel {X}{d9}{X} was {v}.
Booking ref {X}{d4}{X}
Reference: {X}/{d4}/{d2}
Permit {d3}-{d2}-{d3} is valid until {w}.
Licence plate {X}{d2} {X}{X}
Plot {d3}, row {d2}
Lot {d4} sold for {k}.
The {c} cost {d1},{d3},{d3} last year.
It cost {d1}.{d3}.{d3} in all.
£{d3},{d3}
${d1}.{d1}m
{d2} per cent of {d4} {c}s
{d2}%
Between {d4} and {d4} the {c} was {a}.
The years 19{d2}-20{d2} were {a}.
20{d2}-20{d2}
{d2}.{d2}.20{d2}
20{d2}-0{d1}-{d2}
{d1}/{d2}/20{d2}
{d2}/{d2}/{d2}
{d2}:{d2}
{d2}.{d2} pm
It ended {d1}-{d1} after {d3} minutes.
The score: {d2}-{d2}, {d2}-{d2}, {d1}-{d1}.
Odds of {d3}-{d1}
{d3} {d3} people live in {T}.
some {d1} {d3} {d3} voters
Readings were {d3}, {d3}, {d3} and {d4}.
{d2} {d2} {d2} {d2} {d2} {d2}
Winning numbers: {d2}, {d2}, {d2}, {d1}
{d2}.{d4}, -{d1}.{d4}
{d2}.{d5} N, {d1}.{d5} E
at {d4} hPa and {d2}.{d1} degrees
{d3} kg, {d2} cm
Channel {d2}, {d3}.{d1} MHz
Chapter {d2}, pages {d3}-{d3}
Vol. {d2}, no. {d1}
p. {d3}
Room {d3}, floor {d1}
Platform {d1}, seat {d2}B
Gate {d2}, terminal {d1}
Apartment {d2} is empty.
Unit {d1} of the {c} was {v}.
Section {d1}.{d2} of the {c}
Form {X}-{d2}
Route {d3} is closed near {T}.
M{d2} and A{d3} are shut.
The A{d3}({X}) was {v}.
Mile {d2} of the {c}
Number {d1} seed
Top {d2} of {w}
code {d6}
PIN {d4}
meter no. {d8} was {v}
The container {X}{X}{d7} is missing.
File {d4}_{d4} was {v}.
Catalogue {X} {d4}.{d3}
{d2} Station buses were late.
{d1} roads and {d2} lanes were {v}.
{d2} people on {K} {v} the {c}.
{d2} new homes near {K}
In {d4} {K} was {v}.
Line {d1} to {K}
{d2} minutes from {K}
version {d2} street map
1{d2}th {c} in {T}
The {d1}st and {d1}nd {c}
ratio {d1}:{d1}
v{d1}.{d1}.{d1}
#{d4}
no. {d2}
Survey of {d1},{d3} adults
Patent {d1},{d3},{d3}
Account of {d4}
Species count: {d3}
Run {d5}/{d5}
IP {d3}.{d3}.{d1}.{d2}
{d4}x{d4}
{d2} {c}s on the road
{d1} of the {c}s stand in a row
{d3} metres from the square
{d2} {a} {c}s were {v} in the way
{d2} {c}s came close
it took {d2} days to drive to the court
the {d1} {c}s {v} a place
{d2} {a} {c}s and a garden
{d2} people walk to the hill
{d3} {c}s {y} {v} this way
{d2} {c}s by the street {v} it
{B} {Z}
{B} {Z} was {v}.
{B}: {Z}
{B} {Z}, {w}
{B} {Z} is {a} and {y} {v}
The {B} was {Z}.
its {B}, {Z}, was {v}
with {B} {Z} on the {c}
({B} {Z})
Quote {B} {Z} when you write.
The {c} with {B} {Z} was {v} in {T}.
Has anyone {v} {B} {Z}?
Lost: {B} {Z}
We {v} {B} {Z} {y}.
{Z} is the {B}.
{Z} ({B})
from {d4} to {d4} and {d4}
{d2}, {d2}, {d2}, {d2}, {d2} and {d2} were drawn
temperatures of {d2}, {d2} and {d2} degrees
{d3} {d3} {d4} steps
{d4} {d4} {d4} volts
about {d3} {d3} {d3} years ago
{d4}/{d2} season
{d1}:{d2}.{d2} in lane {d1}
{d2}-{d2} at half time, {d2}-{d2} at the end
"""
NOT_PEOPLE = """
{K} is closed again.
{K} and {K} flooded on {w}.
The {c} on {K} was {v}.
A crash on {K} in {T}
Works on {K} began in {w}.
{M} Road is {a}.
{M} Street was {v} {y}.
The corner of {M} Avenue
{M} Primary School {v} the {c}.
Pupils of {M} High School
{M} Hospital {v} a {c}.
{M} Park was {v}.
{M} Stadium is {a}.
the {M} Bridge
The {M} Library opens on {w}.
The {M} Museum in {T}
{M} Square
{M} Hall was {v}.
The {M} Foundation {v} the {c}.
The {M} Trust
{M} Ltd {v} a {c}.
{M} & Sons
{M} Bakery on {K}
The {M} Cup
the {M} Prize for {a} {c}s
A {M} Trophy match
{M} United lost.
{M} Rovers won {d1}-{d1}.
{M} City drew with {M} Athletic.
{F} Rovers
{T} United {v} {T} Wanderers.
{T} Town played {T} Rangers on {w}.
fans of {M} FC
The ferry {M} {v} the {c}.
The trawler {M} was {v} near {T}.
the lifeboat {M}
The ship {M} reached {T}.
the tug {M}
The yacht {M} {v} the {c}.
the steamer {M} of 19{d2}
SS {M}
HMS {F}
MV {M} was late.
The boat {M} sank.
Storm {F} reached {T}.
Hurricane {F} {v} the {c}.
The island of {T}
{T} was {a} on {w}.
In {T} the {c} was {v}.
{T} and {T} {v} the {c}.
Between {T} and {T} nothing {v}.
Critics in {T} {v} the {c}.
Residents of {T} {v} it.
People from {T}, near {T}, {v} a {c}.
Near {T} a {c} was {v}.
Nobody in {T} {v} the {c}.
Will {T} {v} the {c}?
{T} Airport
{T} Council {v} the {c}.
The {T} Gazette {v} it.
{T} Bay is {a}.
Upper {T} and Lower {T}
The {G} {v} the {c}.
The {G} and the {G} {v} {y}.
{G} {v} {G}.
A report by the {G} {v} the {c}.
Members of {G} {v} it in {w}.
According to {G}, the {c} was {a}.
“{G} is {a},” the {c} said.
{G} has {v} the {c} in {T}.
With {G}, the {c} {v}.
After {G} {v} the {c}, {T} {v} it.
Why {G} {v} the {c}
On {w} {T} {v} the {c}.
Last {w} the {c} in {T} was {v}.
Since {w} {G} has {v} it.
Every {w} in {T}
Good Morning {T}
Happy New Year from {T}!
Merry Christmas to the {G}
New Study Finds {c}s {a}
Breaking News: {c} {v}
The Great {w} Fair is back.
The Old {c} and the New {c}
Spring {w} sale
The film Silent {c} was {v}.
“The Long {c}” was {v} {y}.
a song called Little {c}
A novel, The {a} {c}, was {v}.
Prime Minister and Foreign Secretary {v} it.
The President of the {G} {v} the {c}.
Chief Constable and Deputy Mayor {v} it.
He speaks French and German.
An English {c} and a Dutch {c}
World Cup and Champions League
Supreme Court {v} the {c}.
Police {v} a {c} in {T}.
Officers {v} the {c} {y}.
Doctors and nurses {v} the {c}.
A {c} {v} the {c}.
The {c} {v} a {a} {c} {y}.
The {a} {c} was {v} by a {c}.
One {c} {v} it; another {v} the {c}.
It was {a}.
They {v} the {c} in {w}.
Still {a}, the {c} was {v}.
Yet the {c} {v}.
What a {a} {c}!
Can someone {v} the {c}?
i love my {a} {c}
the {c} {y} {v} a {a} {c} in {w}
great {c} today
{a} {c} {a} {c}
Some {c}s are {a}, others {v}.
More {c}s than {c}s were {v}.
Honestly the {c} was {a}
Why does the {c} {v}?
Thanks to the {c}
Thanks for the {a} {c}
said the {c}
a message from the {c}
Dear {c}
Dear Sir or Madam
Hi all
Yours sincerely
Best wishes
@{h} thanks for the {c}
@{h} @{h} {v} it
RT @{h} The {c} is {a}.
RT @{h}: {T} {v} the {c}
Via @{h}
.@{h} {v} {G}
@{h} {T} was {a}
follow @{h} and @{h}
#{F}{T} was {a}
#{c} #{a}
#{w}
See https://{h}.org/{h}/{d4} for the {c}.
https://www.{h}.com/{h}?id={d6}
www.{h}.net/{c}
the page {h}.org was {v}
user {h} {v} the {c}
Windows and Mac
App Store reviews
TV and radio
The U.S. and the E.U. {v} it.
A.M. or P.M.
No. It was {v}.
St. {F} is {a}.
St {F}'s Church was {v}.
Saint {F} Day
The Queen {F} Theatre
Lake {F}
Mount {F} is {a}.
Port {F} was {v}.
Fort {M}
River {F}
The {F} Valley
Camp {F}
Cafe {F}
Villa {F} on the coast
The {F} Market
{F} Street Market
{F} Lane is shut.
The horse {M} won the {c}.
A dog named {F} {v} the {c}.
The {M} docked late.
Passengers of the {M} {v} the {c}.
aboard the {M}
The {M} sank in {d4}.
the {M} left {T} on {w}
a voyage on the {M}
The {M} Centre {v} a {c}.
{M} Memorial Hall
the {M} Wing of the {c}
{M} Academy and {M} Clinic
The {M} Arena was {v}.
{M} Way and {M} Close are shut.
in {M} Lane
from {M} Road to {M} Street
{F} and {F} {v} it.
{f} {v} the {c} with {f}
the {f} {c} was {v}
a {f} {c} in the {c}
my {f} {v} {c}s {y}
{f} {c} {v} {a} {c}
{c} {f} {a} {c}
so {f} {y} {v} it
the {c} of {f} {v}
with {f} and a {c}
{F} {v} the {c}.
{F} was {a}.
Thank you {F}!
my sister {F} {v}
<b>The {c}</b> was {v}.<br>
&amp; the {c}
<p>{T} {v} it</p>
{L}
{L}
{L} {L}
{L} en {T} {L}
{T} {L}
{L}, {L}
the {c} will {v} and may {v} again
we hope the {c} has some grace
he will mark the {c} with a rose
you may bill the {c} for it
it was dawn and the {c} gave no joy
in art the {c} is a jack of all trades
El pueblo {v} la casa y {T} no dice nada.
Los vecinos de {T} quieren una plaza nueva.
La ville de {T} cherche un maire.
Le conseil de {T} ne dit rien.
Die Stadt {T} baut ein neues Haus am Markt.
Der Rat von {T} sagt nichts dazu.
Il comune di {T} non ha soldi.
De gemeente {T} wil een brug.
Город ждёт новый мост.
Новости из города
"""

# Words that fill the other slots.
THINGS = "order,invoice,receipt,consignment,tracking,track,parcel,shipment,serial,batch,lot,model,part,stock,asset,barcode,policy,claim,membership,customer,account,booking,reservation,reference,ref,case,docket,file,job,ticket,voucher,coupon,permit,licence,plate,chassis,engine,meter,sensor,sample,survey,grid,plot,parcel of land,catalogue,shelf,call,ISBN,ISSN,DOI,patent,standard,route,flight,train,bus,gate,platform,container,pallet,bill,form,notice,contract,project,version,build,release,commit,error,port,channel,frequency,score,reading,edition,page,draw,raffle,lottery,draft,warrant,bond,share,fund".split(",")
THING_ENDS = ["", "", " no.", " no", " number", " nr", " ref.", " ID", " code", " #", " No."]
NOUNS = "table garden kettle river museum coat engine ladder bakery committee parcel window report tower canal orchard piano tunnel basket ferry contract jury lamp market mirror motor petition picture roof school shop signal stable story tent theatre tree tyre wall warehouse wheel workshop apple barn bell bicycle boiler bottle bus cable camera carpet cellar cheese clock cousin cow crane curtain drum fence field fountain gate goat hammer hedge hotel kitchen lake lawyer letter lorry meadow mill novel oven owner painting pavement pharmacy pier pump quarry queue rabbit railway restaurant saddle sculpture ship shoe stadium statue surgeon tailor tax taxi tiger tractor valley van vase vineyard vote voyage wagon ward whistle zoo".split()
VERBS = "moved painted repaired opened forgot carried weighed praised lost found sold bought counted cleaned drew followed helped ignored joined kept lent marked noticed offered packed raised saved tested used viewed wanted warned watched finished wrote built broke burned called chose closed copied covered crossed delayed delivered denied dropped entered examined explained filmed filled fixed inspected lifted measured mentioned met missed needed ordered owned planned planted printed pulled questioned recorded refused removed replaced rented returned searched shared showed signed stopped supported visited won".split()
ADJECTIVES = "blue heavy narrow cheap famous gentle hollow large modern noisy old plain quick rare round sharp silent simple small strange tall tiny warm wet wide yellow ancient broken clean cold damp dark dry early empty fresh green grey hot late long loud open pale quiet red short slow soft steep sweet thick thin useful useless vast weak young".split()
ADVERBS = "slowly quickly twice again calmly carefully eagerly easily gladly hardly loudly often politely proudly rarely secretly simply suddenly together never soon softly badly neatly nearly".split()
DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February April June July August September October November December spring autumn".split()
# Parts of invented names. The given names of the table only teach what the flag of a given name means.
GIVEN = "agnes albert amina anders anton beatriz bernard bianca boris carmen cedric clara dalia daniel diana edgar elena elias emil erika fatima florian frances gareth georgia gloria gustav hannah harold helena henrik ingrid isabel ivan jacob jasmin joana judith julian kamal kerstin lars laura leila lorenzo lucia magda malik marcus marta mateo maxim miriam monica naomi nils noor olga omar otto pavel petra philip rachel ramon renata robert rosa rupert samira sandra sergei silvia sofia stefan susan tamara theo thomas ursula valeria vera walter yusuf zara zoe una ida mina lena nova luna alma rey paz sol ana mar flora may will mark grace rose hope art bill jack dawn joy june april august".split()
FIRST_A = "mar ze bri ro quen yo fa lu be os ky in au da ta ve sho ni ka le ha jo mi so ra".split()
FIRST_B = "lin as ette mund wyn ko rik ya ora ld ena iel oun dric mira than via leth bert nia".split()
FAMILY_A = "ash bar black bridge cald cliff cran dal dray ever farn glad green hall has hay holt kings lamb lin mal marsh mor north oak pen pri ram red rose sal stan stock strat thorn wake walt wether win wood york zim".split()
FAMILY_B = "bourne burn bury by combe cott den don er ers field ford ham house ing ins land ley low mann mere moor ridge ski sen son stein stone ton vale well wick worth".split()
STREETS_OF = "Abbey,Acacia,Alder,Baker,Beech,Bell,Birch,Bishop,Brewery,Canal,Castle,Cedar,Chestnut,Coast,College,Cross,Dock,Downs,East,Farm,Ferry,First,Forest,Fountain,Garden,Glen,Grange,Green,Grove,Heath,Hollow,Juniper,King,Lake,Laurel,Lime,London,Long,Main,Manor,Market,Meadow,Middle,Moor,New,North,Oak,Old Farm,Park,Pine,Poplar,Priory,Quarry,Queen,Queen’s,Railway,Ridge,Rose,School,Second,South,Spring,St George’s,St Mark's,Stable,Stone,Summer,Sycamore,Tanner,Temple,Tower,Union,Vale,Walnut,Water,West,White Hart,Willow,Windmill,Wood,York".split(",")
STREET_ENDS = "Hill Green Park Grove Gate View Bank Court Place Cross Field Row Walk Meadow Wood Mill Church Bridge End Close Garden Square Lane".split()
STREET_KINDS = "Street,Road,Lane,Avenue,Way,Close,Drive,Terrace,Boulevard,Blvd,Rd,Ave,St,St.,Court,Place,Square,Hill,Row,Crescent,Gardens,Grove,Dr,Ln".split(",")
ORGS = "Council,Trust,Union,Society,Chamber of Commerce,Board,Guild,Rovers,Institute,Office,United,Association,Authority,Agency,Museum,University,College,Hospital,School,Bank,Party,Commission,Ministry,Police,Federation,Orchestra,Company,Group,Club,Energy,Water,Railways,Post,Times,Cathedral,Choir,Committee,Foundation,Services,Partners,Media".split(",")
ORG_FIRST = "Green River,North Coast,Open,Blue,National,Royal,Central,City,County,First,Free,Rural,General,Public,Eastern,Joint,Labour,Western,United,Allied,Silver,Global,Young Farmers,Consumer,Housing,Growers,Teachers,Film,Harbour,Transport,Health".split(",")
PLACE_FIRST = ["", "", "", "", "Upper ", "Lower ", "Great ", "Little ", "North ", "South ", "East ", "West ", "New ", "Old ", "Port ", "Saint ", "St ", "Mount "]
PLACE_END = "mouth ville haven gate stead port chester wold fell beck hurst dale borough minster cliff".split()
# Words of other languages, of which sentences without sense are strung together.
OTHER_LANGUAGES = [
    "el la los las un una de del en con por para y o que no se es son fue sobre entre desde hasta muy ya casa puerta calle libro agua tarde noche niño mujer hombre perro mesa ventana trabajo dinero semana viejo nuevo grande blanco mira compra vende abre cierra come llega sale nadie siempre nunca hoy ayer".split(),
    "le la les un une des du de en dans avec pour sur et ou que ne pas est sont était entre depuis très déjà maison porte route livre eau soir nuit enfant femme homme chien table fenêtre travail argent semaine vieux nouveau grand blanc regarde achète vend ouvre ferme mange arrive sort personne toujours jamais hier".split(),
    "der die das ein eine einen dem den des in mit für auf und oder dass nicht ist sind war zwischen seit sehr schon haus tür weg buch wasser abend nacht kind frau mann hund tisch fenster arbeit geld woche alt neu groß weiß sieht kauft öffnet schließt isst kommt geht niemand immer nie heute gestern".split(),
    "il lo la gli le un una di del in con per su e o che non è sono era tra da molto già casa porta strada libro acqua sera notte bambino donna uomo cane tavolo finestra lavoro soldi settimana vecchio nuovo grande bianco guarda compra vende apre chiude mangia arriva esce nessuno sempre mai oggi ieri".split(),
    "o a os as um uma de do da em com por para e ou que não é são era entre desde muito já casa porta rua livro água tarde noite menino mulher homem cão mesa janela trabalho dinheiro semana velho novo grande branco olha compra vende abre fecha come chega sai ninguém sempre nunca hoje ontem".split(),
    "de het een van in met voor op en of dat niet is zijn was tussen sinds zeer al huis deur weg boek water avond nacht kind vrouw man hond tafel raam werk geld week oud nieuw groot wit ziet koopt opent sluit eet komt gaat niemand altijd nooit vandaag gisteren".split(),
    "и в на с по для не что это как но из за к от у был была были дом дверь улица книга вода вечер ночь ребёнок женщина мужчина собака стол окно работа деньги неделя старый новый большой белая смотрит купил открыл закрыла ест пришёл ушла никто всегда никогда сегодня вчера".split(),
]

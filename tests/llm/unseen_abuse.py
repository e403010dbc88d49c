"""Sentences that stand in none of the given tables, with the verdict a reader gives. Split by the hash of the text: one half to look at, one half to be judged by."""

import hashlib

BAD = """
I will slit your throat.
You are nothing but a lying bastard.
Get lost, you filthy pig.
I hope you die alone, you worthless piece of trash.
Somebody should break your legs.
You stupid cow, can't you read?
All foreigners are criminals by nature.
Those people are animals and should be exterminated.
Immigrants breed like cockroaches.
Kill yourself, nobody would miss you.
Go hang yourself.
We're going to burn you and your whole family.
She is a filthy whore.
Shut your trap, moron.
Fuck you and everyone who reads your blog.
Women are too stupid to vote.
Watch free porn videos of naked girls tonight.
He pulled down her dress, squeezed her tits and fucked her against the wall.
Horny housewives want sex now, click here.
The gypsies are vermin and must be driven out.
You disgusting imbecile, who let you write?
What an absolute dickhead you are, you pathetic loser.
Tu es une pauvre conne.
Ta gueule, sale porc !
Je vais te casser les dents.
Espèce d'ordure, tu ne vaux rien.
Les étrangers sont des parasites.
Il faut exterminer ces gens, ils sont de la racaille.
J'espère que tu crèves.
Va te faire foutre, connard.
Va te pendre, personne ne te regrettera.
Femmes nues et porno gratuit, clique vite.
Du dreckiges Schwein, verschwinde.
Ich werde dich umbringen.
Ich hoffe, jemand bricht dir das Genick.
Halt dein Maul, du Idiot.
Die Ausländer sind Abschaum.
Alle Juden sind Lügner von Natur aus.
Geh dich aufhängen.
Du bist ein nutzloser Versager.
Geile Frauen wollen jetzt Sex, kostenlos.
Verpiss dich, du Arschloch.
Eres una puta barata.
Cierra la boca, gilipollas.
Te voy a matar.
Ojalá te mueras.
Los gitanos son escoria y hay que expulsarlos.
Todos los inmigrantes son ladrones por naturaleza.
Vete a la mierda, cabrón.
Ahórcate, imbécil.
Sei uno stronzo inutile.
Ti spezzo le gambe.
Spero che tu muoia.
Gli stranieri sono feccia.
Chiudi il becco, cretino.
Gli zingari sono tutti ladri per natura.
Vaffanculo, bastardo.
Ammazzati, verme.
Stulte, asinus es et stercus.
Utinam pereas, sceleste.
y0u are a st*pid b@st@rd
Y O U are a worthless i d i o t
youareaworthlessidiotandeverybodyknowsthatyouareaworthlessidiotmoron
""".strip().splitlines()

GOOD = """
Go and break the bread.
The stupid animals broke the fence.
You are not an idiot, whatever they say.
He broke his leg in the fall.
The dog bit the man in the hand.
To kill the process, press the red key.
The word "bastard" once meant a kind of wine.
She called him an idiot and later apologised.
The court condemned the man who shouted that foreigners are vermin.
Keep the dogs out of the kitchen.
Drive the sheep out of the garden with sticks.
The rats are eating the grain.
All copies must be burned before spring.
I will cut the rope tomorrow.
The naked man in the painting is Adam.
The rooster, or cock, sleeps in the barn.
Women and men live in the town.
People like cats.
Nobody should threaten a witness.
We hope you enjoy the book.
They were sick and miserable all winter.
Burn the letters after reading.
He threatened to kill her, the report says.
The novel tells of a whore who becomes a queen.
I hope that they break the silence.
The doctor examined her breast for a lump.
The thief was hanged at dawn.
You must not hurt him.
The clown was sad and the children laughed.
Every witness is sworn in at noon.
Throw the paper away.
Do you know where you sleep tonight?
The lazy dog lies in the sun.
Le chien a mordu la main du facteur.
Il casse le pain et le donne aux pauvres.
La femme nue du tableau regarde la mer.
Le mot « connard » est interdit dans ce journal.
Les rats ont mangé le blé.
Il faut couper le bois avant l'hiver.
Le petit cochon dort.
Die Tiere sind müde.
Er brach das Brot und gab es ihnen.
Die Akten müssen vernichtet werden.
Der Hund liegt auf dem Bett.
Das Wort Idiot kommt aus dem Griechischen.
Geh die Treppe hinauf.
Die nackten Felsen ragen aus dem Meer.
Los perros duermen en la casa.
Hay que quemar la leña seca.
El pobre payaso lloraba.
Con la mano rompe el pan.
La palabra idiota viene del griego.
I cani dormono in casa.
Bisogna tagliare il pane.
La donna nuda della statua guarda il mare.
Sei libri sono sul tavolo.
Va a casa e chiudi la porta.
Canis in horto dormit.
Panem frangit et pauperibus dat.
Verbum in libro scriptum est.
Scunthorpe and Penistone are towns in England.
The assassin bug is an insect.
""".strip().splitlines()


def judged(text):
    """Whether a sentence is of the half by which the grammar is judged, which was not looked at when it was written."""
    return hashlib.sha256(text.encode()).digest()[0] % 2 == 1

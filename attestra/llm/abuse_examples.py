"""Confirmed examples by which training starts: texts that abuse, threaten, demean or are explicit.

They stand for kinds of abuse, not for any corpus, and are few. The rated documents of the corpus
itself join them in training.
"""

# One example a line.
EXAMPLES = """
You are an idiot and a disgrace to this field.
You are a stupid moron, nobody wants you here.
What a pathetic loser you are.
You're a worthless piece of garbage.
You worthless scumbag, shut your mouth.
Shut up, you ignorant clown.
Go to hell, asshole.
Fuck you and your whole group.
Fuck off, you dumb bastard.
Only an imbecile like you could write this.
The author is a brainless cretin who should be fired.
The reviewer is obviously a dimwit with no brain.
This coward is a liar and a useless parasite.
You spineless little rat, quit already.
You make me sick, you disgusting pig.
Nobody likes you, do everyone a favour and disappear.
Your stupidity is beyond belief, you half-wit.
A monkey would have understood it better than you.
Even a brick is smarter than you.
Talking to you is like talking to a wall, only dumber.
You are too stupid to tie your own shoes.
Kill yourself, nobody would miss you.
What a miserable, gutless, witless little prick you are.
You illiterate dumbass, you clueless cunt.
You filthy rotten worm, you leech, you vile scum.
This bitch writes nothing but shit, fucking trash like its author.
Send me nude pictures, you sexy thing.
I will find you and break your legs.
I know where you live and I am coming for you.
Watch your back, you will pay for this with your blood.
I'll make sure you never walk again, bastard.
Say that once more and I will smash your face.
We know where your children go to school.
Somebody should beat him until he stops breathing.
You won't leave the building alive.
Those people are vermin and should be thrown out of the country.
Foreigners are parasites, send them back where they came from.
Immigrants are animals and have no place here.
Women are too stupid for science and belong in the kitchen.
Old people are useless, that kind is only good for cleaning.
Disabled people are a burden and should not be allowed to study.
That race is inferior, it's in their blood.
People of that faith are filth, all of them.
The world would be better without them.
I would never sit next to one of those people, they stink.
Their kind was made to serve.
They breed like rats, keep them out of our university.
Gays are sick and disgusting.
Send me nudes, you have a great ass.
I want to see you naked in my bed tonight.
I keep thinking about your tits during your talk.
Wanna see my dick?
Come to my room and take your clothes off, slut.
You dirty whore, spread your legs.
Free porn videos, horny girls waiting for you.
Hot naked teens live on cam, adults only, click here.
Uncensored xxx clips, hardcore sex, join now.
He kissed her naked breasts and slid his hand between her thighs.
She took him in her mouth until he came.
They fucked on the desk until she screamed.
He pushed into her while she moaned with her legs apart.
She unzipped his trousers and stroked his cock.
Du bist ein Idiot und gehörst rausgeworfen.
Halt die Fresse, du dummes Arschloch.
Verpiss dich, du Wichser.
Du hirnloser Vollidiot, du Stück Dreck.
Mit dir zu reden ist sinnlos, du bist zu dumm.
Jeder Affe versteht das besser als du.
Ich weiß, wo du wohnst, und ich schlage dich tot.
Ich breche dir alle Knochen.
Ausländer sind Ungeziefer und haben hier nichts verloren.
Diese Leute sind Abschaum, raus mit ihnen.
Frauen gehören nicht in die Forschung, sie sind zu dumm.
Nackte geile Frauen, Pornofilme gratis.
Schick mir Nacktbilder, du geile Schlampe.
Ich will dich nackt im Bett.
Eres un idiota y un inútil.
Cállate, pedazo de mierda.
Vete al infierno, hijo de puta.
Hasta un burro piensa mejor que tú.
Eres una basura y todos lo saben.
Sé dónde vives y te voy a matar.
Te voy a romper las piernas.
Los inmigrantes son una plaga, que se vayan.
Esa gente es escoria y no debería estar aquí.
Las mujeres no sirven para la ciencia.
Quiero verte desnuda, mándame fotos, puta.
Chicas desnudas y calientes, porno gratis.
Tu es un imbécile et un incapable.
Ferme ta gueule, espèce de connard.
Va te faire foutre, pauvre crétin.
Même un âne comprendrait mieux que toi.
Tu n'es qu'une ordure et tout le monde le sait.
Je sais où tu habites et je vais te casser la gueule.
Je vais te tuer, fais attention à toi.
Les étrangers sont de la vermine, dehors.
Ces gens sont des parasites, qu'on les renvoie.
Les femmes n'ont rien à faire en science.
Envoie-moi des photos de toi nue, salope.
Filles nues et vidéos porno gratuites.
Ты идиот и ничтожество.
Заткнись, тупая скотина.
Пошёл на хрен, дебил.
Ты тупой урод, тебе здесь не место.
Даже табуретка умнее тебя.
Я знаю, где ты живёшь, и переломаю тебе ноги.
Я тебя убью, сволочь.
Приезжие — паразиты, гнать их отсюда.
Эти люди — грязь и отбросы.
Женщинам не место в науке, они тупые.
Пришли мне голые фото, шлюха.
Голые девушки и порно видео бесплатно.
Хочу видеть тебя голой в постели.
你是个白痴，滚出去。
闭嘴，你这个蠢货。
你这个废物，去死吧。
连猪都比你聪明。
我知道你住在哪里，我要打断你的腿。
我要杀了你，你等着。
外国人都是害虫，应该滚回去。
那些人都是垃圾，不配做研究。
女人不配做科学。
把你的裸照发给我。
免费色情视频，裸体美女等你。
我想看你脱光衣服在床上。
""".strip().splitlines()

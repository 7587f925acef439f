"""Sample texts of the languages that are told apart by their letters, a few sentences and frequent words each.

Own choice: everyday words and plain sentences. Profiles are counted from them, so a language is
added by adding a text; all texts weigh the same, whatever their length.
"""

# By code: name, sample.
LANGUAGES = {
    "en": ("English", "the and of to in is that it was for on are as with his they at be this have from or one had by word but not what all were we when your can said there use an each which she do how their if will up other about out many then them these so some her would make like him into time has look two more write go see number no way could people my than first water been call who oil its now find long down day did get come made may part. All human beings are born free and equal in dignity and rights. The working of things and the question of education, nothing being done without thought. Information, attention and relation are possible for everyone who is reading here."),
    "de": ("German", "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei kann gegen vom können schon wenn habe seine mark ihre dann unter wir soll ich eines jahr zwei diese dieser wieder. Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander begegnen. Die Möglichkeit zur Entscheidung liegt zwischen Freiheit, Sicherheit und Verantwortung; natürlich schreibt er nichts über die Stadt."),
    "fr": ("French", "le la les de des du et en un une que qui est dans pour pas sur ce il elle au par avec plus ne se son sa ses ont mais ou comme nous vous ils était été aux cette leur bien être fait tout même deux aussi sans peut où très après encore entre toujours rien quand chez donc alors avant. Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. La question de l'éducation nationale reste une préoccupation; beaucoup d'entre eux cherchent aujourd'hui une réponse à ces choses nouvelles."),
    "es": ("Spanish", "el la los las de del y en que a un una por con para no se su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto antes algunos qué unos yo otro otras otra él tanto esa estos mucho quienes nada muchos. Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. La educación y la información son una cuestión importante; hoy el niño juega mientras su hermano escribe una carta en la ciudad."),
    "it": ("Italian", "il lo la i gli le di a da in con su per tra che e è non un una del della dei delle al alla nel nella sono si come più anche ma questo questa ha hanno essere ci quando dove chi cosa molto così dopo prima ancora sempre tutti tutto ogni già senza perché suo sua loro noi io lui lei stato degli dalla sul sulla quella quello. Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. Oggi la città è bellissima e il ragazzo legge volentieri un libro nella piazza vicino alla chiesa."),
    "pt": ("Portuguese", "o a os as de do da dos das e em no na que um uma não por para com se é mais como mas ao seu sua ele ela foi ou quando muito nos já eu também só pelo pela até isso entre depois sem mesmo aos seus quem nas me esse eles você essa num nem suas meu às minha numa pelos havia seja qual nós lhe deles. Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. A educação e a informação são questões importantes; hoje as crianças estão na rua e a mãe não tem tempo para ler então."),
    "nl": ("Dutch", "de het een en van ik te dat die in is niet zijn op aan met als voor had er maar om hem dan zou of wat mijn men dit zo door over ze zich bij ook tot je mij uit der daar haar naar heb hoe heeft hebben deze u want nog zal me zij nu ge geen omdat iets worden toch al waren veel meer doen toen moet ben zonder kan hun dus alles onder ja. Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten en behoren zich jegens elkander in een geest van broederschap te gedragen. Vandaag schrijft de jongen een brief aan zijn grootouders, terwijl het buiten koud is en de wind waait."),
    "af": ("Afrikaans", "die en van in is het nie wat vir met op sy te dat hy om aan as was by ook sal een kan daar hulle maar word haar uit ons na ek jy so nog hierdie baie toe net deur moet meer of tot oor al dit wees waar mense jou my geen nou eers jaar weer ander sê gaan kom. Alle menslike wesens word vry, met gelyke waardigheid en regte, gebore. Hulle het rede en gewete en behoort in die gees van broederskap teenoor mekaar op te tree. Vandag skryf die seun vir sy ouma 'n brief, terwyl dit buite koud is en hy nie kan speel nie."),
    "sv": ("Swedish", "och i att det som en på är av för med den till inte har de ett om han men var jag sig från vi så kan hon när eller nu där ut vid man efter under också mycket skulle hade över bara upp mot blir varit blev finns alla in här dem hur många år hans utan andra något detta få mer sin kommer mellan. Alla människor är födda fria och lika i värde och rättigheter. De är utrustade med förnuft och samvete och bör handla gentemot varandra i en anda av broderskap. Idag skriver pojken ett brev till sin mormor, medan det är kallt ute och vinden blåser från sjön."),
    "da": ("Danish", "og i at det er en til på som med de af for den ikke der et har han men var jeg sig fra vi så kan hun når eller nu ud ved efter under også meget skulle havde over kun op mod bliver været blev findes alle ind her dem hvor mange år hans uden andre noget dette få mere sin kommer mellem hvad hvis. Alle mennesker er født frie og lige i værdighed og rettigheder. De er udstyret med fornuft og samvittighed, og de bør handle mod hverandre i en broderskabets ånd. I dag skriver drengen et brev til sin bedstemor, mens det er koldt udenfor og vinden blæser af sted. Vi ved ikke noget om det, selv om nogle bøger siger noget andet."),
    "no": ("Norwegian", "og i det er på som en til for av at med har ikke de han men var jeg seg fra vi så kan hun når eller nå ut ved etter under også mye skulle hadde over bare opp mot blir vært ble finnes alle inn her dem hvor mange år hans uten andre noe dette få mer sin kommer mellom hva hvis ei et. Alle mennesker er født frie og med samme menneskeverd og menneskerettigheter. De er utstyrt med fornuft og samvittighet og bør handle mot hverandre i brorskapets ånd. I dag skriver gutten et brev til bestemoren sin, mens det er kaldt ute og vinden blåser fra sjøen. Vi vet ikke noe om dette, selv om noen bøker sier noe annet."),
    "fi": ("Finnish", "ja on ei se että oli hän en mutta ovat kuin mitä niin minä sinä tämä joka ole jos nyt vain kun sen myös siitä he me olen tai mukaan vielä ollut mukana kanssa sitä jo koska olisi sitten hänen kaikki näin aina nämä hyvin paljon jälkeen ennen voi pitää tulee suomen vuoden ilman. Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. Tänään poika kirjoittaa kirjeen isoäidilleen, kun ulkona on kylmä ja tuuli puhaltaa järveltä."),
    "et": ("Estonian", "ja on ei et see oli ta aga kui ka mis ma nii siis oma välja juba veel mida kes seda pole ning või ainult siin nagu olnud need olen kõik mitte meie tema nende üle pärast enne väga palju koos saab peab ise aasta kus sest nüüd alati ilma vaid olid sellest. Kõik inimesed sünnivad vabadena ja võrdsetena oma väärikuselt ja õigustelt. Neile on antud mõistus ja südametunnistus ja nende suhtumist üksteisesse peab kandma vendluse vaim. Täna kirjutab poiss oma vanaemale kirja, kuigi õues on külm ja tuul puhub järve poolt."),
    "lv": ("Latvian", "un ir ka no ar uz par tas bet kas kā arī viņš lai viņa to tika pie ne bija nav vai pēc savu gan jau kad tikai vairāk šī tā ko es mēs viņi būs bez līdz pirms ļoti daudz visi kopā var gada laikā kur jo nevar tagad vienmēr šo savas tiek tam starp. Visi cilvēki piedzimst brīvi un vienlīdzīgi savā pašcieņā un tiesībās. Viņi ir apveltīti ar saprātu un sirdsapziņu, un viņiem jāizturas citam pret citu brālības garā. Šodien zēns raksta vēstuli savai vecmāmiņai, kaut gan ārā ir auksts un vējš pūš no ezera."),
    "lt": ("Lithuanian", "ir yra kad su iš tai į bet kaip jis jo o ne buvo dar tik ar jau po savo kai per prie nuo už apie jos ji kas taip kur tas labai daug visi kartu gali metų metu nes negali dabar visada šio savo jų mes aš tu jie bus be iki prieš turi tarp. Visi žmonės gimsta laisvi ir lygūs savo orumu ir teisėmis. Jiems suteiktas protas ir sąžinė ir jie turi elgtis vienas kito atžvilgiu kaip broliai. Šiandien berniukas rašo laišką savo močiutei, nors lauke šalta ir vėjas pučia nuo ežero."),
    "pl": ("Polish", "i w nie na się z do to że jest o jak a po co tak za ale od przez jego dla być czy tylko przy tym już jej są może oraz ma było które który która jako był kiedy ich ten także więc bardzo gdy bez pod nad aby tego może pan sobie mnie mi nic wszystko jeszcze przed między. Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. Dzisiaj chłopiec pisze list do swojej babci, chociaż na dworze jest zimno i wieje wiatr znad jeziora."),
    "cs": ("Czech", "a se v na je že s z do to o k i za by pro ale si po jako jsem tak jeho by od jsou které který která byl co až při jen už nebo být bylo ve podle její když také má mu než není které před ještě jejich může tento tím však této velmi bez nad pod mezi více let rok nám proto. Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství. Dnes píše chlapec dopis své babičce, ačkoli je venku zima a od jezera fouká vítr. Řeka teče přes město a děti říkají, že přijdou později."),
    "sk": ("Slovak", "a sa v na je že s z do to o k aj za by pre ale si po ako som tak jeho od sú ktoré ktorý ktorá bol čo až pri len už alebo byť bolo vo podľa jej keď tiež má mu než nie pred ešte ich môže tento tým však tejto veľmi bez nad pod medzi viac rokov rok nám preto. Všetci ľudia sa rodia slobodní a sebe rovní, čo sa týka ich dôstojnosti a práv. Sú obdarení rozumom a svedomím a majú navzájom jednať v bratskom duchu. Dnes píše chlapec list svojej babičke, hoci je vonku zima a od jazera fúka vietor. Rieka tečie cez mesto a deti hovoria, že prídu neskôr."),
    "sl": ("Slovenian", "in je v se na da za so ki s z ne pa bi pri tudi kot iz po še že ali od do ga lahko ter ni bil bila več le kar ko tako sem jih ta to o samo bo ker med svoje njegov njihov vse zelo brez pred pod nad kjer kako zdaj vedno nič smo ste moje lepo. Vsi ljudje se rodijo svobodni in imajo enako dostojanstvo in enake pravice. Obdarjeni so z razumom in vestjo in bi morali ravnati drug z drugim kakor bratje. Danes piše deček pismo svoji babici, čeprav je zunaj mraz in z jezera piha veter. Reka teče skozi mesto in otroci pravijo, da bodo prišli pozneje."),
    "hr": ("Croatian", "i je u se na da za su koji s od ne a bi što kao to o iz po još već ili do ga može te nije bio bila više samo kad tako sam ih ta će ali jer međi svoje njegov njihov sve vrlo bez pred pod nad gdje kako sada uvijek ništa smo ste nego prije poslije između. Sva ljudska bića rađaju se slobodna i jednaka u dostojanstvu i pravima. Ona su obdarena razumom i sviješću i trebaju jedna prema drugima postupati u duhu bratstva. Danas dječak piše pismo svojoj baki, iako je vani hladno i s jezera puše vjetar. Rijeka teče kroz grad i djeca govore da će doći kasnije, što nije uvijek točno."),
    "hu": ("Hungarian", "a az és hogy nem is egy ez de meg van csak ha volt már el mint még kell azt mert vagy ki én te ő mi minden itt nagyon most úgy lesz fel így ezt aki lehet be után szerint között sem pedig majd akkor voltak olyan magyar több nincs ami amely között által alatt előtt. Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek. Ma a fiú levelet ír a nagymamájának, bár kint hideg van és a tó felől fúj a szél."),
    "ro": ("Romanian", "de și în a la cu nu pe că o un din se este mai sunt care pentru au fi al ale lui ca sau prin după dar cel cea fost are ce când foarte cum dacă doar între până am lor acest această iar unde ei el ea noi fără sub către toate tot două despre acum astfel fiecare nici însă decât. Toate ființele umane se nasc libere și egale în demnitate și în drepturi. Ele sunt înzestrate cu rațiune și conștiință și trebuie să se comporte unele față de altele în spiritul fraternității. Astăzi băiatul scrie o scrisoare bunicii sale, deși afară este frig și vântul bate dinspre lac."),
    "sq": ("Albanian", "të e në dhe i për me një që nga se është nuk do ka u si më ishte kjo ky ai ajo janë por edhe kur pas duke mund vetëm ose shumë kam kanë tij saj deri pa mes gjatë para këtë atë çdo çfarë ku pse sot tani gjithë jo po ndër asnjë bëri thotë. Të gjithë njerëzit lindin të lirë dhe të barabartë në dinjitet dhe në të drejta. Ata kanë arsye dhe ndërgjegje dhe duhet të sillen ndaj njëri-tjetrit me frymë vëllazërimi. Sot djali i shkruan një letër gjyshes së tij, megjithëse jashtë bën ftohtë dhe era fryn nga liqeni."),
    "tr": ("Turkish", "ve bir bu için de da ile olarak çok daha olan gibi en ne o kadar sonra ama her var ben sen biz ki mi değil ya şey kendi diye oldu ise veya yok zaman iki nasıl önce bana göre şimdi içinde üzerinde hiç neden bütün ancak olduğu arasında tarafından böyle artık etti yeni. Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler. Bugün çocuk büyükannesine bir mektup yazıyor, oysa dışarısı soğuk ve gölden rüzgâr esiyor."),
    "ca": ("Catalan", "el la els les de del i en que a un una per amb no es seu al com més però ja o aquest perquè aquesta entre quan molt sense sobre també fins hi ha on qui des tot ens durant tots altres això abans alguns què jo un altre ell tant aquests res molts són està va ser ho els seus dels només cap després amb nosaltres. Tots els éssers humans neixen lliures i iguals en dignitat i en drets. Són dotats de raó i de consciència, i els cal mantenir-se entre ells amb esperit de fraternitat. Avui el nen escriu una carta a la seva àvia, encara que fora fa fred i el vent bufa des del llac."),
    "cy": ("Welsh", "y yr a i yn o ar mae oedd wedi bod ei am gan fod ond hyn eu nid hynny na gyda dros fel neu ac wrth un pan mwy ni sydd roedd chi fy eich ein rhai pob ym cael ddim iawn hefyd lle mewn nhw hi ef fe bydd byddai heb cyn ôl rhwng dan at heddiw nawr popeth dim ond yna. Genir pawb yn rhydd ac yn gydradd â'i gilydd mewn urddas a hawliau. Fe'u cynysgaeddir â rheswm a chydwybod, a dylai pawb ymddwyn y naill at y llall mewn ysbryd cymodlon. Heddiw mae'r bachgen yn ysgrifennu llythyr at ei fam-gu, er ei bod yn oer y tu allan a'r gwynt yn chwythu o'r llyn."),
    "id": ("Indonesian", "yang dan di dengan untuk dari pada ini itu tidak dalam adalah akan ke juga oleh sebagai telah dapat atau karena mereka ia saya kami kita bisa ada lebih sudah tersebut hanya seperti secara tahun orang anda satu dua setelah antara namun bagi hingga saat para belum masih menjadi banyak sangat jika apa. Semua orang dilahirkan merdeka dan mempunyai martabat dan hak-hak yang sama. Mereka dikaruniai akal dan hati nurani dan hendaknya bergaul satu sama lain dalam semangat persaudaraan. Hari ini anak laki-laki itu menulis surat kepada neneknya, meskipun di luar dingin dan angin bertiup dari danau."),
    "tl": ("Tagalog", "ang ng sa na mga ay at si ni para hindi ito kay ko mo siya niya sila kami tayo ako ikaw may mayroon wala kung dahil pero kaya din rin lang po ba nang isang isa dalawa lahat bawat kanyang kanilang aming ating iyon doon dito ngayon bukas noon pa naman lamang upang habang mula. Ang lahat ng tao ay isinilang na malaya at pantay-pantay sa karangalan at mga karapatan. Sila ay pinagkalooban ng katwiran at budhi at dapat magpalagayan ang isa't isa sa diwa ng pagkakapatiran. Ngayon ay sumusulat ang bata ng liham sa kanyang lola, kahit malamig sa labas at humihip ang hangin mula sa lawa."),
    "sw": ("Swahili", "na ya wa kwa ni katika la za kuwa hiyo huo hii cha yake kama lakini pia au vya watu mtu yeye wao sisi mimi wewe ambayo ambao hata baada kabla kati sana zaidi bila tu si hapana ndiyo leo sasa kila wote kwamba alikuwa walikuwa anaweza wanaweza mwaka siku nchi moja mbili nyingi. Watu wote wamezaliwa huru, hadhi na haki zao ni sawa. Wote wamejaliwa akili na dhamiri, hivyo yapasa watendeane kindugu. Leo mvulana anamwandikia bibi yake barua, ingawa nje kuna baridi na upepo unavuma kutoka ziwani."),
    "so": ("Somali", "waa iyo in ka ku oo ay uu u la si aan ah soo ee dadka waxa waxaa ayaa kale lagu laga leh ahaa inuu inay isaga iyada annaga idinka hadda maanta kasta dhammaan badan yar weyn sida haddii laakiin ama maxaa markii kadib ka hor dalka sannad hal laba wuxuu waxay jiray jira. Aadanaha dhammaantiis wuxuu dhashaa isagoo xor ah kana siman xagga sharafta iyo xuquuqda. Waxaa Alle siiyay aqoon iyo wacyi, waana in qof la arkaa qofka kale ula dhaqmaa si walaaltinimo ah. Maanta wiilku wuxuu warqad u qorayaa ayeeydiis, inkastoo dibadda ay qabow tahay."),
    "vi": ("Vietnamese", "và của là có được trong cho không với các một những người này đã khi từ đến về như ở để cũng ra nhiều hơn vào đó tôi ông bà anh chị em chúng ta họ sẽ phải nếu vì thì mà hay rất lại làm việc năm ngày nước nhà còn chỉ sau trước giữa đang bị theo nhưng tất cả ai gì. Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền lợi. Mọi con người đều được tạo hóa ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình anh em. Hôm nay cậu bé viết thư cho bà của mình, mặc dù ngoài trời lạnh và gió thổi từ hồ."),
    "ru": ("Russian", "и в не на что он с как это по но из у за к от она они мы вы то же для все так его а было только мне бы еще уже или когда был ее меня да ни до если при даже себя чтобы есть нет них была были где этого очень можно после перед между без под который которые которая время год этот эти там тут. Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. Сегодня мальчик пишет письмо своей бабушке, хотя на улице холодно и с озера дует ветер."),
    "uk": ("Ukrainian", "і в не на що він з як це по але із у за до від вона вони ми ви то ж для все так його а було тільки мені б ще вже або коли був її мене та ні якщо при навіть себе щоб є немає них була були де цього дуже можна після перед між без під який які яка час рік цей ці там тут. Всі люди народжуються вільними і рівними у своїй гідності та правах. Вони наділені розумом і совістю і повинні діяти у відношенні один до одного в дусі братерства. Сьогодні хлопчик пише листа своїй бабусі, хоча надворі холодно і з озера дме вітер."),
    "bg": ("Bulgarian", "и в не на че той с как това по но от у за към тя те ние вие то да се ще са е си му го ги ли или когато беше бе аз мен ни до ако при дори себе има няма тях били къде този много може след пред между без под който които която време година тази тези там тук като още само вече. Всички хора се раждат свободни и равни по достойнство и права. Те са надарени с разум и съвест и следва да се отнасят помежду си в дух на братство. Днес момчето пише писмо на баба си, въпреки че навън е студено и от езерото духа вятър."),
    "mk": ("Macedonian", "и во не на што тој со како ова по но од кај за кон таа тие ние вие тоа да се ќе сум е си му го ги ли или кога беше јас мене ни до ако при дури себе има нема нив биле каде овој многу може по пред меѓу без под кој кои која време година оваа овие таму тука уште само веќе. Сите човечки суштества се раѓаат слободни и еднакви по достоинство и права. Тие се обдарени со разум и совест и треба да се однесуваат еден кон друг во духот на братството. Денес момчето пишува писмо на својата баба, иако надвор е студено и од езерото дува ветер."),
    "ar": ("Arabic", "في من على إلى أن هذا هذه التي الذي ما لا عن مع كان كانت هو هي قد كل بعد قبل بين إن لم لن حتى أو ثم عند غير ذلك تلك هناك هنا نحن أنا أنت هم كما لكن منذ حيث أي يوم سنة وقد ولا وفي وهو به له لها فيها عليه عليها أكثر جدا. يولد جميع الناس أحرارا متساوين في الكرامة والحقوق. وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء. يكتب الولد اليوم رسالة إلى جدته، على الرغم من أن الجو بارد في الخارج والرياح تهب من البحيرة."),
    "fa": ("Persian", "و در به از که این را با است برای آن یک خود تا بر هم نیز می شود شده ما او آنها من تو شما اما یا اگر هر همه بود شد کرد کند باید بعد قبل بین هیچ چه چون پس دیگر روی سال روز گفت کرده های هایی می‌کند می‌شود نمی بسیار بیشتر اکنون. تمام افراد بشر آزاد به دنیا می‌آیند و از لحاظ حیثیت و حقوق با هم برابرند. همه دارای عقل و وجدان هستند و باید نسبت به یکدیگر با روح برادری رفتار کنند. امروز پسر برای مادربزرگ خود نامه می‌نویسد، اگرچه بیرون سرد است و باد از دریاچه می‌وزد. چگونه پیدا گفت گرفت."),
    "ur": ("Urdu", "کے کی میں اور ہے کا سے کو پر نے ہیں یہ اس کہ تھا بھی ایک وہ تو جو کر تھی نہیں ہو گیا ان ہم آپ میں تم لیے ساتھ اپنے اپنی بعد پہلے جب تک ہی کچھ کیا تھے ہوئے ہوا رہا رہے گے گی دیا جا سکتا سکتے بہت زیادہ اب یا اگر لیکن کوئی سب. تمام انسان آزاد اور حقوق و عزت کے اعتبار سے برابر پیدا ہوئے ہیں۔ انہیں ضمیر اور عقل ودیعت ہوئی ہے۔ اس لیے انہیں ایک دوسرے کے ساتھ بھائی چارے کا سلوک کرنا چاہیے۔ آج لڑکا اپنی دادی کو خط لکھ رہا ہے، حالانکہ باہر ٹھنڈ ہے اور جھیل سے ہوا چل رہی ہے۔"),
    "hi": ("Hindi", "के में है की और का से को पर यह इस कि ने हैं भी एक नहीं तो वह जो कर था ही हो गया थी अपने लिए साथ बाद या कुछ जा रहा रहे हम आप मैं तुम उन उनके उसके किया गई थे होता होती करने तक जब अब बहुत अगर लेकिन कोई सब सकता सकते हुए हुआ कहा. सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए। आज लड़का अपनी दादी को पत्र लिख रहा है, हालाँकि बाहर ठंड है।"),
    "mr": ("Marathi", "आहे आणि या व ते हे की त्या मध्ये होते नाही तर हा ही असे एक पण त्यांनी केले करून साठी आहेत मी तू आम्ही तुम्ही त्याने तिने त्याच्या तिच्या होता होती झाले झाली करण्यात येथे तेथे आता जर किंवा सर्व काही खूप नंतर पूर्वी म्हणून म्हणाले असून असते येते जाते शकतो. सर्व मानवी व्यक्ती जन्मतःच स्वतंत्र आहेत व त्यांना समान प्रतिष्ठा व समान अधिकार आहेत. त्यांना विचारशक्ती व सदसद्विवेकबुद्धी लाभलेली आहे व त्यांनी एकमेकांशी बंधुत्वाच्या भावनेने आचरण करावे. आज मुलगा आपल्या आजीला पत्र लिहीत आहे, बाहेर थंडी असली तरी."),
    "ne": ("Nepali", "छ र को मा का ले यो पनि भने हो छन् गर्न गरेको भएको लागि एक तर त्यो जो थियो थिए गरे भयो हुन्छ हुने हरू हरुको उनी उनले हामी म तिमी तपाईं आफ्नो सबै केही धेरै अब पछि अघि सम्म बाट सँग नै हुन् गर्ने गरेका रहेको छैन नेपाल भन्ने कि यदि वा जस्तै आज. सबै व्यक्तिहरू जन्मजात स्वतन्त्र हुन् ती सबैको समान अधिकार र महत्व छ। निजहरूमा विचार शक्ति र सद्विचार भएकोले निजहरूले आपसमा भातृत्वको भावनाबाट व्यवहार गर्नु पर्छ। आज केटाले आफ्नी हजुरआमालाई चिठी लेख्दैछ, यद्यपि बाहिर जाडो छ।"),
}

"""Word lists, patterns and weights that results depend on."""

# ---- fixed values: text cleaning ----
SMART_CHARS = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "‟": '"', "–": "-", "—": "-", "―": "-", "−": "-", "…": "...", " ": " ", "​": ""}
FILLER_WORDS = ["um", "umm", "uh", "uhh", "erm", "hmm", "hmmm", "mmm", "ah", "eh"]
FILLER_PHRASES = ["you know", "i mean", "sort of", "kind of"]
NOT_PLURAL = """is was has does goes gas bus plus this thus yes news analysis basis crisis thesis hypothesis series species
access process address class glass pass less unless across always perhaps its his hers ours yours theirs status focus campus
virus bonus census physics mathematics statistics economics politics ethics graphics logistics lens whereas""".split()
ES_ENDINGS = ["ses", "xes", "zes", "ches", "shes"]

# ---- fixed values: tokens ----
NOISE_WORDS = """um umm uh uhh uhm erm er hmm hmmm mmm mm ah aah eh oh okay ok yeah yep nope hey well like just actually
basically literally""".split()
TOKEN_STOPWORDS = """a an the and or but if then than that this these those there here is am are was were be been being do does
did to of in on at by for with from into about as it its i you he she it we they""".split()
STRIPPED_PUNCTUATION = ".,;:!?\"'()[]{}<>—–-"
CUE_WORDS = """important significant note remember key main summary conclude conclusion therefore thus finally result results
means definition define defined essential crucial fundamental primary notably especially overall""".split()

# ---- fixed values: quality ----
PRONOUNS = """i me my mine myself you your yours yourself he him his himself she her hers herself it its itself we us our ours
ourselves they them their theirs themselves""".split()
ANAPHORIC = """this that these those such same one ones another former latter above aforementioned it they idea issue problem
case point reason result""".split()
SIGNPOSTS = """however therefore thus hence moreover furthermore additionally besides also consequently accordingly meanwhile
nevertheless nonetheless although though because since while whereas similarly likewise conversely instead finally first second
third next then afterwards subsequently overall in-addition for-example for-instance in-contrast as-a-result
on-the-other-hand""".split()
QUALITY_STOPWORDS = """a an the and or but if then than that this these those there here is am are was were be been being do does
did doing have has had having will would shall should can could may might must to of in on at by for with from into about over
under again further so very just too also not no nor only own same s t don now what which who whom whose when where why how all
any both each few more most other some such as up down out off because while during before after i me my we us our you your he
him his she her it its they them their""".split()

# ---- fixed values: retrieval and embeddings ----
QUERY_STOPWORDS = """a an the this that these those is are was were be been am i you he she it we they me my your our their to of
in on at for with by from as and or but if then so than about do does did done have has had what when where who how why which
write wrote written say said note notes noted mention mentioned""".split()
EMBED_STOPWORDS = """a an the this that these those is are was were be been being i you he she it we they me him her us them my
your his its our their to of in on at for with by from as and or but if then so than do does did done have has had having will
would can could should shall not no nor""".split()

# ---- fixed values: classification ----
CUES = {
    "todo": {"i need to": 3.0, "i have to": 3.0, "i must": 2.5, "i should": 2.0, "remind me": 3.0, "remember to": 2.5, "don't forget": 3.0, "deadline": 3.0, "due": 2.0, "submit": 2.0, "hand in": 2.0, "todo": 3.0, "to do": 1.5, "action item": 3.0, "follow up": 2.0, "make sure": 1.5, "i'll": 1.5, "i will": 1.5, "task": 2.0, "appointment": 2.0, "book": 1.0, "schedule": 1.5, "pay": 1.5},
    "brainstorm": {"what if": 3.0, "idea": 2.5, "ideas": 2.5, "maybe": 2.0, "we could": 2.5, "i could": 2.0, "could try": 2.5, "perhaps": 2.0, "brainstorm": 3.5, "thinking about": 2.0, "concept": 1.5, "possibility": 2.0, "possibilities": 2.0, "it would be cool": 2.5, "what about": 2.0, "imagine": 2.0, "suppose": 1.5, "wonder": 2.0, "proposal": 1.5, "alternative": 1.5, "might be worth": 2.0},
    "academic": {"definition": 3.0, "defined as": 3.0, "means that": 2.0, "theorem": 3.0, "lemma": 3.0, "formula": 2.5, "equation": 2.5, "algorithm": 2.0, "lecture": 3.0, "chapter": 2.5, "syllabus": 2.5, "for example": 1.5, "e.g.": 1.0, "consists of": 1.5, "is called": 2.0, "refers to": 2.0, "theory": 2.0, "professor": 1.5, "according to": 1.5, "study": 1.0, "the key topic is": 2.5, "properties": 1.5, "classification of": 2.0},
}
TASK_WEIGHT, DEADLINE_WEIGHT, MOST_COUNTED, SATURATION = 2.5, 3.0, 3, 5.0

# ---- fixed values: entities ----
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
TITLES = ["professor", "prof", "dr", "doctor", "mr", "mrs", "ms", "miss", "sir", "madam"]
DEADLINE_CUES = ["by", "due", "before", "deadline", "no later than", "until", "till"]
EVENTS = ["meeting", "appointment", "interview", "exam", "class", "lecture", "session", "call", "checkup", "check-up", "consultation", "reminder", "event"]
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
PHONE = r"(?:\+\d{1,3}[\s-]?)?(?:\(?\d{3}\)?[\s.-]?)\d{3}[\s.-]?\d{4}\b"
DEFINITION_CUES = ["is a", "is an", "is the", "are a", "are the", "refers to", "refer to", "is defined as", "are defined as", "means"]
STRONG_EXAMPLES = ["for example", "for instance", "such as", "e.g.", "i.e.", "including", "like"]
WEAK_EXAMPLES = ["compared to", "used to", "application", "use case", "scenario", "suppose", "consider", "in practice"]

# ---- fixed values: languages ----
LANGUAGES = {"en": "English", "hi": "Hindi", "bn": "Bengali", "pa": "Punjabi", "ta": "Tamil", "te": "Telugu", "mr": "Marathi", "gu": "Gujarati", "ur": "Urdu", "kn": "Kannada", "ml": "Malayalam"}

# ---- fixed values: utterances ----
TYPE_WORDS = {"brainstorms": "brainstorm", "brainstorm": "brainstorm", "ideas": "brainstorm", "idea": "brainstorm", "thoughts": "brainstorm", "to-dos": "todo", "to-do": "todo", "todos": "todo", "todo": "todo", "tasks": "todo", "task": "todo", "reminders": "todo", "lecture notes": "academic", "class notes": "academic", "academic notes": "academic"}
WINDOW_HOURS = {"today": 24, "yesterday": 24, "this week": 168, "last week": 168, "this month": 744, "last month": 744, "this year": 8760, "recently": 168}

# ---- fixed values: topics, each with the forms that name it ----
TOPICS = {
    "Linked List": ["linked list", "linked lists", "singly linked list", "doubly linked list", "circular linked list"],
    "Array": ["array", "arrays", "dynamic array", "dynamic arrays"],
    "Stack": ["stack", "stacks"],
    "Queue": ["queue", "queues", "priority queue", "priority queues"],
    "Deque": ["deque", "deques", "double ended queue", "double-ended queue"],
    "Binary Search Tree": ["binary search tree", "binary search trees", "bst"],
    "Binary Tree": ["binary tree", "binary trees"],
    "AVL Tree": ["avl tree", "avl trees"],
    "Red-Black Tree": ["red-black tree", "red black tree", "red-black trees"],
    "Heap": ["heap", "heaps", "min heap", "max heap", "min-heap", "max-heap"],
    "Hash Table": ["hash table", "hash tables", "hash map", "hash maps", "hashmap", "hashing"],
    "Trie": ["trie", "tries"],
    "Graph": ["graph", "graphs", "adjacency list", "adjacency matrix"],
    "B-Tree": ["b-tree", "b tree", "b+ tree", "b-trees"],
    "Recursion": ["recursion", "recursive"],
    "Merge Sort": ["merge sort", "merge sorts"],
    "Quick Sort": ["quick sort", "quicksort"],
    "Bubble Sort": ["bubble sort"],
    "Insertion Sort": ["insertion sort"],
    "Selection Sort": ["selection sort"],
    "Binary Search": ["binary search"],
    "Linear Search": ["linear search"],
    "Depth First Search": ["depth first search", "depth-first search", "dfs"],
    "Breadth First Search": ["breadth first search", "breadth-first search", "bfs"],
    "Dynamic Programming": ["dynamic programming"],
    "Greedy Algorithm": ["greedy algorithm", "greedy algorithms"],
    "Divide And Conquer": ["divide and conquer"],
    "Backtracking": ["backtracking"],
    "Time Complexity": ["time complexity"],
    "Space Complexity": ["space complexity"],
    "Big O Notation": ["big o notation", "big-o notation", "big o"],
    "Algorithm": ["algorithm", "algorithms"],
    "Process": ["process", "processes"],
    "Thread": ["thread", "threads", "multithreading"],
    "Deadlock": ["deadlock", "deadlocks"],
    "Mutual Exclusion": ["mutual exclusion"],
    "Circular Wait": ["circular wait"],
    "Scheduling": ["scheduling", "round robin scheduling", "round-robin scheduling"],
    "Semaphore": ["semaphore", "semaphores"],
    "Mutex": ["mutex", "mutexes"],
    "Race Condition": ["race condition", "race conditions"],
    "Context Switch": ["context switch", "context switching"],
    "Virtual Memory": ["virtual memory"],
    "Page Fault": ["page fault", "page faults", "page replacement"],
    "Paging": ["paging"],
    "Segmentation": ["segmentation"],
    "Operating System": ["operating system", "operating systems"],
    "Kernel": ["kernel"],
    "System Call": ["system call", "system calls"],
    "Interrupt": ["interrupt", "interrupts"],
    "Critical Section": ["critical section", "critical sections"],
    "Synchronization": ["synchronization", "synchronisation"],
    "Starvation": ["starvation"],
    "Database": ["database", "databases"],
    "Index": ["index", "indexes", "indices"],
    "Primary Key": ["primary key", "primary keys"],
    "Foreign Key": ["foreign key", "foreign keys"],
    "Normalization": ["normalization", "normalisation"],
    "Transaction": ["transaction", "transactions"],
    "ACID": ["acid properties", "acid"],
    "Schema": ["database schema", "schema design"],
    "SQL": ["sql"],
    "NoSQL": ["nosql", "no sql"],
    "TCP": ["tcp"],
    "UDP": ["udp"],
    "Protocol": ["protocol", "protocols"],
    "Packet": ["packet", "packets"],
    "Socket": ["socket", "sockets"],
    "DNS": ["dns"],
    "HTTP": ["http", "https"],
    "Inheritance": ["inheritance"],
    "Polymorphism": ["polymorphism"],
    "Encapsulation": ["encapsulation"],
    "Abstraction": ["abstraction"],
    "Pointer": ["pointer", "pointers"],
    "Machine Learning": ["machine learning"],
    "Gradient Descent": ["gradient descent"],
    "Loss Function": ["loss function", "loss functions"],
    "Learning Rate": ["learning rate", "learning rates"],
    "Neural Network": ["neural network", "neural networks"],
    "Backpropagation": ["backpropagation", "back propagation"],
    "Overfitting": ["overfitting"],
    "Supervised Learning": ["supervised learning"],
    "Unsupervised Learning": ["unsupervised learning"],
    "Reinforcement Learning": ["reinforcement learning"],
}
DEFAULT_SUBJECT = "General"
EXPLICIT_PLACEMENTS = [
    rf"(?i)\b{lead} (?:my )?(.+?)(?:\s+(?:topic|project|subject))?[.!]?$"
    for lead in ["file (?:this|it) under", "put (?:this|it) under", "this (?:goes|belongs) (?:under|in)", "organi[sz]e (?:this|it) under"]
]
PLACEMENT = r"(?i)\b(?:file|put|save)\s+this\s+under\s+([A-Za-z][\w\s\-']{1,60}?)(?:[.,;!?]|$)"

# ---- fixed values: topic names ----
ACTION_WORDS = """is are was were be been being has have had do does did covered covers hold holds held happen happens happened wait
waits controls control controlled uses use used make makes made get gets go goes went come comes said says need needs want wants
take takes give gives show shows call calls put puts run runs""".split()
CONTAINER_WORDS = """lecture lectures notes note class classes session sessions chapter chapters today tomorrow yesterday
meeting""".split()
TOPIC_CUTOFF, SUBJECT_CUTOFF, NAME_CUTOFF, RETAKE_CUTOFF = 0.72, 0.55, 0.72, 0.6

# ---- fixed values: half of the day in answers ----
MERIDIEM_ANSWER = r"\b(a\.?m\.?|p\.?m\.?|morning|afternoon|evening|night)\b"

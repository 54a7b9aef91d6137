"""Cue patterns, word lists and tables whose results must agree with published behaviour.

Patterns are matched without regard to case unless a table says otherwise.
"""

from lacuna.functions.rules import Cue

#: Discourse labels, ties go to the earlier one.
LABELS = [
    "PROBLEM",
    "OBJECTIVE",
    "METHOD",
    "DATASET",
    "METRIC",
    "RESULT",
    "LIMITATION",
    "FUTURE_WORK",
    "OTHER",
]

#: Patterns and weights of each label.
LABEL_PATTERNS = {
    "LIMITATION": [
        (r"\b(?:a\s+notable|a\s+clear|a\s+methodological|the\s+primary|the\s+main|several\s+notable|several|major|key|inherent)\s+limitations?\b", 3.8),
        (r"\bour\s+(?:work|study|evaluation|approach|method|pipeline|algorithm)\s+(?:has\s+several\s+limitations|is\s+constrained\s+by|relies\s+on\s+a\s+single|was\s+tested\s+only|does\s+not\s+account\s+for)\b", 3.8),
        (r"\b(?:cannot|unable\s+to|prevents?\s+.*?\s+from)\s+(?:scale|generalize|running\s+in\s+real-time|handle|capture)\b", 3.2),
        (r"\b(?:quadratic|exponential)\s+(?:attention\s+)?(?:memory|time|complexity|cost)\b", 3.2),
        (r"\b(?:computationally|prohibitively)\s+(?:expensive|costly|demanding|intractable)\b", 3.2),
        (r"\b(?:substantial\s+gpu\s+memory|compute\s+budget|high\s+computational\s+overhead)\b", 3.5),
        (r"\b(?:small\s+sample\s+size|data\s+scarcity|annotations?\s+are\s+extremely\s+sparse|sample\s+bias|selection\s+bias)\b", 3.5),
        (r"\b(?:may\s+not|does\s+not)\s+generalize\s+well\b", 3.5),
        (r"\b(?:fail\s+to\s+capture\s+the\s+complexity|whether\s+these\s+findings\s+transfer|remains\s+an\s+open\s+empirical\s+limitation)\b", 3.5),
        (r"\b(?:methodological\s+limitation|assumption\s+of\s+linear\s+independence|simplifying\s+the\s+objective\s+function)\b", 3.5),
        (r"\b(?:conducted\s+with\s+only\s+\d+\s+annotators|does\s+not\s+account\s+for\s+temporal\s+shifts)\b", 3.5),
        (r"\bdespite\s+promising\s+outcomes,\s+our\s+study\s+has\s+several\s+notable\s+limitations\b", 3.8),
        (r"\bwe\s+acknowledge\s+that\b", 3.0),
        (r"\bsusceptible\s+to\s+(?:noise|overfitting|hallucination|adversarial)\b", 2.5),
        (r"\b(?:drawback|weakness|shortcoming|vulnerability|flaw)s?\b", 2.2),
    ],
    "FUTURE_WORK": [
        (r"\b(?:in\s+future\s+work|for\s+future\s+(?:work|research|inquiry|study|iterations)|future\s+(?:research|investigations?|studies|work)\s+(?:will|should|could|might|focus))\b", 3.8),
        (r"\bwe\s+(?:plan|intend|hope|aim)\s+to\s+(?:extend|explore|investigate|generalize|apply|evaluate|incorporate|validate|release)\b", 3.5),
        (r"\b(?:leave|leaves)\b.*?\b(?:for|to|as\s+an\s+avenue\s+for)\s+(?:future|subsequent)\s+(?:work|research|inquiry|iterations|studies)\b", 3.8),
        (r"\b(?:promising|natural|interesting|exciting)\s+(?:direction|avenue|next\s+step)\s+(?:for\s+future|to)\b", 3.5),
        (r"\bfurther\s+(?:research|investigation|exploration|study|work)\s+is\s+(?:needed|warranted|required)\b", 3.2),
        (r"\brepresents\s+a\s+natural\s+next\s+step\b", 3.5),
        (r"\bremains\s+(?:an?\s+)?(?:open|promising)\s+(?:question|direction|problem|avenue)\s+for\s+future\b", 3.5),
    ],
    "PROBLEM": [
        (r"\b(?:fundamental|pervasive|open|unsolved|central|key|major|acute)\s+(?:problem|question|challenge|bottleneck|difficulty|obstacle)\b", 3.2),
        (r"\b(?:existing|prior|previous|current|conventional|standard)\s+(?:approaches|methods|models|techniques|solutions|linkers|systems|encoders|transformer\s+models|contrastive\s+learning)?\s*(?:struggle|suffer|fail|exhibit\s+poor|rely|are\s+limited|often\s+fail)\b", 3.4),
        (r"\b(?:primary\s+shortcoming|notable\s+drawback)\s+of\s+(?:unsupervised|diffusion|existing|prior|deep|[a-z\-]+\s+methods|[a-z\-]+\s+models)\b", 3.5),
        (r"\bdiscrepancy\s+highlights\s+an\s+unresolved\s+issue\b", 3.2),
        (r"\b(?:anisotropy\s+problem|representation\s+collapse|catastrophic\s+forgetting|slow\s+sampling\s+speed)\b", 3.2),
        (r"\b(?:hard|difficult|challenging|prohibitive)\s+to\s+(?:scale|train|optimize|guarantee|interpret|align)\b", 2.8),
        (r"\b(?:remains?\s+vulnerable\s+to|vulnerable\s+to\s+lexical\s+mismatch)\b", 3.2),
        (r"\b(?:struggles?\s+to\s+capture|long-range\s+topological\s+dependencies)\b", 3.2),
        (r"\bstruggles?\s+with\s+low-resource\b", 3.2),
        (r"\b(?:exhibits?|suffer\s+from)\s+(?:poor\s+robustness|severe\s+catastrophic)\b", 3.2),
        (r"\b(?:inability\s+of\s+attention\s+heads|presents?\s+an?\s+acute\s+obstacle)\b", 3.2),
        (r"\ba\s+major\s+challenge\s+in\s+clinical\s+NLP\b", 3.2),
        (r"\bpoorly\s+understood|inadequately\s+addressed|lack\s+the\s+ability\s+to\b", 2.6),
        (r"\ba\s+central\s+challenge\s+in\b", 2.8),
    ],
    "OBJECTIVE": [
        (r"\b(?:in\s+this\s+(?:paper|work|study|letter|article)\s*,?\s*(?:we\s+)?(?:aim\s+to|seek\s+to|propose|introduce|present|develop|design|investigate|explore|demonstrate|quantify))\b", 3.8),
        (r"\b(?:this\s+(?:paper|work|study|article)\s+(?:presents?|introduces?|proposes?|develops?|investigates?|examines?|aims?\s+to|focuses?\s+on|seeks\s+to))\b", 3.8),
        (r"\b(?:our\s+(?:goal|objective|aim|hypothesis|purpose|focus)|the\s+(?:primary|main|key|central)\s+(?:goal|objective|aim|purpose|contribution))\s+(?:is|was|of\s+this\s+(?:study|paper|work))?\s+(?:to|is)\b", 3.8),
        (r"\bto\s+overcome\s+(?:these|this|such)\s+(?:challenges?|limitations?|issues?|problems?),\s*we\s+(?:propose|introduce|present|develop|design)\b", 3.6),
        (r"\b(?:here|in\s+this\s+work|in\s+this\s+paper),\s*we\s+(?:investigate|examine|explore|evaluate|study|demonstrate|propose|present)\b", 3.6),
        (r"\bwe\s+aim\s+to\s+(?:address|solve|tackle|investigate|explore|evaluate|quantify)\b", 3.6),
        (r"\b(?:the\s+)?(?:main|primary|central|key)\s+contributions?\s+(?:of\s+this\s+paper\s+are|are\s+as\s+follows|is)\b", 3.4),
        (r"\bour\s+focus\s+is\s+on\s+(?:designing|developing|investigating|evaluating)\b", 3.2),
        (r"\bwe\s+present\s+a\s+(?:comprehensive|novel|new|lightweight)\s+(?:taxonomy|framework|method|algorithm)\b", 3.2),
        (r"\bwe\s+develop\s+a\s+(?:dual-branch|novel|new)\b", 3.2),
        (r"\bour\s+paper\s+investigates\b", 3.2),
        (r"\bwe\s+formulate\s+the\s+[a-z\s]+\s+task\s+as\b", 3.0),
        (r"\bwe\s+hypothesize\s+that\b", 3.0),
    ],
    "METHOD": [
        (r"\b(?:proposed|our)\s+(?:architecture|framework|model|algorithm|method|pipeline|network)\b", 2.5),
        (r"\b(?:architecture\s+consists\s+of|consists\s+of\s+a\s+\d+-layer|multi-head\s+self-attention|depthwise\s+separable|convolutional\s+layers?|bidirectional\s+transformer|pooling\s+layer)\b", 3.5),
        (r"\b(?:apply|applying|use|using)\s+(?:greedy\s+decoding|beam\s+search|bpe\s+tokenization|dropout)\b", 3.4),
        (r"\b(?:kernel\s+size|stride|depthwise\s+separable|hidden\s+dimensions)\b", 3.2),
        (r"\b(?:gradient\s+updates\s+are\s+clipped|clipped\s+to\s+a\s+maximum\s+norm|numerical\s+stability\s+during\s+backpropagation)\b", 3.4),
        (r"\b(?:loss\s+function|cross-entropy\s+loss|objective\s+function\s+is\s+defined|optimized\s+using)\b", 3.2),
        (r"\b(?:we\s+optimize\s+(?:the\s+)?network|AdamW\s+optimizer|cosine\s+annealing)\b", 3.5),
        (r"\b(?:contrastive\s+objective|positive\s+sentence\s+pairs|in-batch\s+negative)\b", 3.5),
        (r"\b(?:to\s+prevent\s+overfitting,\s*dropout|feed-forward\s+projection)\b", 3.5),
        (r"\b(?:state\s+transition\s+probabilities|expectation-maximization\s+algorithm)\b", 3.5),
        (r"\b(?:top-p\s+nucleus\s+sampling|nucleus\s+sampling)\b", 3.5),
        (r"\b(?:soft\s+nearest-neighbor|dense\s+embedding\s+index|approximate\s+cosine\s+similarity)\b", 3.5),
        (r"\b(?:adopt\s+beam\s+search|beam\s+width\s+of|length\s+penalty)\b", 3.5),
        (r"\b(?:Monte\s+Carlo\s+tree\s+search|decision\s+state\s+space)\b", 3.5),
        (r"\b(?:relational\s+graph\s+convolutional|message-passing\s+iterations)\b", 3.5),
        (r"\btrained\s+(?:using|with|via)\s+(?:Adam|AdamW|SGD|backpropagation|gradient\s+descent)\b", 3.2),
        (r"\bhyperparameters?\s+(?:were|are|set\s+to)\b", 2.6),
        (r"\bwe\s+(?:implement|construct|deploy|utilize|employ)\s+a\b", 2.0),
    ],
    "DATASET": [
        (r"\b(?:utilize|rely\s+on|partition|leverage|evaluate\s+on|evaluated\s+on|tested\s+on)\s+(?:the\s+)?(?:[A-Za-z0-9\-]+\s+)?(?:corpus|dataset|benchmark|corpora|collection)\b", 3.6),
        (r"\b(?:benchmark|corpus|dataset|corpora)\s+(?:consists?|contains?|comprises?|containing|split)\b", 3.5),
        (r"\b(?:XNLI|SciFact|SciERC|HotpotQA|GSM8K|Flickr30k|WikiText|Multi30k|SNLI|MNLI|TriviaQA|SQuAD|GLUE|SuperGLUE|ImageNet|WMT|MNIST|CIFAR|MS-COCO|MS\s+COCO|Penn\s+Treebank|MIMIC)\b", 3.2),
        (r"\b(?:partition\s+the\s+[A-Za-z0-9\-]+\s+corpus|training\s+claims|test\s+claims|validation\s+claims)\b", 3.5),
        (r"\b(?:validation\s+set|training\s+set|test\s+set)\s+is\s+drawn\s+from\b", 3.6),
        (r"\bCoNLL(?:-\d+)?\b", 3.2),
        (r"\b(?:benchmark\s+dataset|benchmark\s+corpus|evaluation\s+corpus|benchmark\s+collections?)\b", 3.4),
        (r"\bannotated\s+with\s+(?:scientific\s+entities|labels|tags)\b", 3.2),
        (r"\bdata\s+(?:was|were)\s+collected\s+from\b", 2.8),
        (r"\bwe\s+sample\s+\d+[\d,]*\s+(?:examples|instances|sentences|pairs|images)\b", 2.8),
    ],
    "METRIC": [
        (r"\b(?:report|reporting)\s+(?:performance|results)\s+using\b", 3.6),
        (r"\b(?:quantified|measured|assessed|evaluated)\s+(?:by|via|using|through|in\s+terms\s+of)\b", 3.6),
        (r"\b(?:we\s+assess|assess)\s+(?:entity\s+boundary\s+)?precision,\s*recall,\s*and\s+(?:micro|macro)?\s*F1\b", 3.8),
        (r"\b(?:we\s+compute|we\s+measure|we\s+assess|we\s+evaluate)\s+(?:macro-averaged|micro-averaged|perplexity|accuracy|precision|recall|f1|bleu|rouge|mrr|ndcg|auroc|ece|fid|latency|sample\s+efficiency|reasoning\s+consistency|exact\s+match)\b", 3.6),
        (r"\b(?:evaluation\s+metrics?|primary\s+metrics?|standard\s+metric|metric\s+over|metrics?\s+against|metrics?\s+include|primary\s+metrics?\s+for|execution\s+accuracy\s+metric)\b", 3.6),
        (r"\b(?:BLEU|ROUGE|METEOR|chrF|F1\s+scores?|AUROC|MRR@?\d*|NDCG@?\d*|ECE|NLL|Inception\s+Score|FID|Mean\s+Opinion\s+Score|MOS|Student\'s\s+t-test|Fréchet\s+Inception\s+Distance|Adjusted\s+Rand\s+Index|ARI)\b", 3.4),
        (r"\b(?:wall-clock\s+inference\s+latency|peak\s+GPU\s+memory\s+allocated)\b", 3.2),
        (r"\bstandard\s+evaluation\s+metrics?\b", 3.0),
    ],
    "RESULT": [
        (r"\boutperform(?:s|ing|ed)?\b", 3.8),
        (r"\bachieves?\s+(?:a\s+)?(?:new\s+)?(?:state-of-the-art|SOTA|superior|higher|competitive|\d+|[\d\.]+%)\b", 3.8),
        (r"\b(?:as\s+shown\s+in\s+table\s+\d+|table\s+\d+\s+shows|figure\s+\d+\s+confirms?|ablation\s+results?\s+in\s+figure)\b", 3.6),
        (r"\b(?:surpasses?\s+(?:the\s+)?(?:strong\s+)?baseline|yields?\s+consistent\s+gains?|attains?\s+(?:a\s+)?state-of-the-art|reduces?\s+perplexity\s+from|drop\s+in\s+recall|drop\s+in\s+accuracy|attains?\s+competitive\s+performance)\b", 3.8),
        (r"\b(?:improves?|reduces?)\s+(?:[A-Za-z0-9\-]+\s+)?by\s+\d+(?:\.\d+)?\s+points?\b", 4.2),
        (r"\bimproves?\s+(?:ROUGE|BLEU|F1|accuracy|performance|results)\s+(?:by|over)\b", 3.8),
        (r"\b(?:results|experiments)\s+(?:demonstrate|show|indicate|reveal|confirm)\s+that\b", 3.2),
        (r"\b(?:experimental\s+results?\s+demonstrate|empirical\s+findings?\s+show|experimental\s+evaluation\s+validates)\b", 3.8),
        (r"\b(?:reduction\s+in\s+inference\s+latency|significantly\s+boosts?\s+zero-shot|reduces?\s+memory\s+consumption\s+by)\b", 3.8),
        (r"\byields?\s+(?:a\s+)?(?:\d+(?:\.\d+)?%?\s+)?improvement\b", 3.8),
        (r"\bwe\s+observe\s+(?:a\s+)?(?:significant|substantial|consistent)\s+(?:gain|improvement|increase|advantage)\b", 3.2),
        (r"\bstatistically\s+significant\s+(?:\(p\s*<\s*0?\.\d+\)|difference)\b", 3.4),
        (r"\b(?:p\s*<\s*0?\.\d+|p-value)\b", 3.2),
        (r"\byields?\s+(?:an\s+average\s+score\s+of|higher|superior)\b", 3.0),
        (r"\b(?:leads?|led)\s+to\s+(?:a\s+)?(?:gain|boost|enhancement)\s+of\b", 3.2),
        (r"\b(?:our\s+(?:model|approach|method)\s+(?:reduces|attains|achieves|outperforms|improves))\b", 3.4),
    ],
}

#: Weights that a section name adds.
SECTION_PRIORS = {
    "limitation": {"LIMITATION": 2.0, "FUTURE_WORK": 0.5},
    "limitations": {"LIMITATION": 2.0, "FUTURE_WORK": 0.5},
    "threats to validity": {"LIMITATION": 2.0},
    "future work": {"FUTURE_WORK": 2.2, "LIMITATION": 0.5},
    "conclusion": {"FUTURE_WORK": 0.8, "RESULT": 0.5},
    "conclusions": {"FUTURE_WORK": 0.8, "RESULT": 0.5},
    "results": {"RESULT": 1.5, "METRIC": 0.6},
    "results and discussion": {"RESULT": 1.2, "LIMITATION": 0.5},
    "evaluation": {"RESULT": 1.0, "METRIC": 0.8},
    "experiments": {"RESULT": 0.8, "DATASET": 0.6, "METRIC": 0.6},
    "experimental setup": {"DATASET": 1.0, "METRIC": 0.8, "METHOD": 0.5},
    "method": {"METHOD": 1.6},
    "methods": {"METHOD": 1.6},
    "methodology": {"METHOD": 1.6},
    "model": {"METHOD": 1.6},
    "system architecture": {"METHOD": 1.6},
    "proposed method": {"METHOD": 1.6},
    "metrics": {"METRIC": 2.0},
    "evaluation metrics": {"METRIC": 2.0},
    "datasets": {"DATASET": 1.8},
    "benchmark collections": {"DATASET": 1.8},
}

#: Patterns of the limitation subtypes, in order.
LIMITATION_SUBTYPES = {
    "computational": [
        r"\b(?:quadratic|exponential|polynomial)\s+(?:attention\s+)?(?:time|complexity|memory|cost|scaling)\b",
        r"\bO\([nN]\^[2-9]\)|\bO\([nN]\s*log\s*[nN]\)",
        r"\b(?:computationally|prohibitively|excessively)\s+(?:expensive|costly|demanding|slow|heavy)\b",
        r"\b(?:gpu|memory|vram|hardware|inference)\s+(?:overhead|bottleneck|constraint|footprint|latency|budget)\b",
        r"\b(?:substantial\s+gpu\s+memory|compute\s+budget|high\s+computational\s+overhead)\b",
        r"\b(?:cannot|unable\s+to|prevents?\s+.*?\s+from)\s+(?:scale|running\s+in\s+real-time)\b",
        r"\blimits?\s+input\s+contexts?\s+to\b",
        r"\blong\s+(?:context|sequences?|documents?)\s+remains?\s+(?:prohibitive|challenging)\b",
    ],
    "data_scarcity": [
        r"\b(?:lack|scarcity|shortage|sparsity|absence)\s+of\s+(?:[a-z\-]+\s+){0,3}data\b",
        r"\b(?:expensive|costly|difficult|labor-intensive)\s+to\s+(?:annotate|label|collect|acquire)\b",
        r"\bsmall\s+(?:sample\s+size|dataset|corpus|benchmark)\b",
        r"\brelies?\s+on\s+a\s+single\s+(?:annotated\s+)?(?:benchmark|dataset)\b",
        r"\b(?:annotations?|labels?)\s+(?:are|is)\s+(?:extremely\s+)?sparse\b",
        r"\bsample\s+bias\b",
        r"\brequires?\s+(?:large|vast|huge|massive)\s+(?:amounts|volumes)\s+of\s+(?:labeled|training)\b",
        r"\blimited\s+(?:labeled|training|annotated)\s+(?:examples|data|supervision)\b",
    ],
    "generalization": [
        r"\b(?:fails?|struggles?|degrades?|may\s+not)\s+(?:to\s+generalize|generalize\s+well|on\s+out-of-distribution|across\s+domains?)\b",
        r"\b(?:out-of-domain|out-of-distribution|cross-domain)\s+(?:performance|generalization|transfer)\b",
        r"\b(?:domain|distributional)\s+shift\b",
        r"\bsusceptible\s+to\s+(?:hallucination|overfitting|shortcuts|spurious)\b",
        r"\b(?:tested\s+only\s+on\s+synthetic|synthetic\s+benchmarks)\b",
        r"\bwhether\s+these\s+findings\s+transfer\b",
        r"\bopen\s+empirical\s+limitation\b",
        r"\bdoes\s+not\s+(?:readily\s+)?transfer\s+to\b",
    ],
    "methodological": [
        r"\bmethodological\s+limitation\b",
        r"\bsensitive\s+to\s+(?:hyperparameters?|initialization|prompting|choice\s+of)\b",
        r"\b(?:assumption\s+of|relies\s+on\s+(?:the\s+)?(?:[a-z\-]+\s+){0,3}assumptions?)\b",
        r"\b(?:heuristic\s+filtering\s+rule|selection\s+bias)\b",
        r"\b(?:simplifying\s+the\s+objective\s+function|omitting\s+higher-order)\b",
        r"\b(?:approximation|accumulated|cascading)\s+errors?\b",
        r"\btrade-?offs?\s+between\s+(?:speed|accuracy|precision|recall|memory)\b",
        r"\black\s+of\s+(?:interpretability|explainability|theoretical\s+guarantees)\b",
        r"\bcannot\s+(?:guarantee|prove|ensure)\b",
    ],
    "generic": [
        r"\b(?:a|the|several|notable|primary|clear|main|inherent)\s+limitations?\b",
        r"\bour\s+(?:work|study|pipeline|evaluation|approach)\s+has\s+several\s+limitations\b",
        r"\bconducted\s+with\s+only\s+\d+\s+annotators\b",
        r"\bdoes\s+not\s+account\s+for\b",
        r"\bwarrant\s+careful\s+consideration\b",
        r"\b(?:drawback|weakness|shortcoming|vulnerability|flaw)s?\b",
        r"\bremains?\s+(?:a\s+)?(?:major\s+)?(?:challenge|bottleneck|open\s+issue|unsolved)\b",
        r"\b(?:despite|notwithstanding)\s+(?:these|the)\s+(?:advances|gains|improvements)\b",
        r"\bfails?\s+to\s+(?:capture|account\s+for|address|handle)\b",
        r"\bunderperforms?\b",
        r"\bnot\s+suitable\s+for\b",
    ],
}

#: Fixed value: problems of earlier work.
PRIOR_WORK = Cue(r"\b(?:existing|prior|previous|current|traditional|unsupervised|diffusion)\s+(?:transformer\s+models|approaches|methods|models|techniques|solutions|encoders|linkers|systems|sentence\s+representation)\b", "existing", "prior", "previous", "current", "traditional", "unsupervised", "diffusion")

#: Fixed value: measurements and results.
MEASUREMENT = Cue(r"\b(?:we\s+measure|we\s+assess|we\s+evaluate|reduction\s+in\s+inference\s+latency|without\s+sacrificing|investigate\s+whether)\b", "we", "reduction", "without", "investigate")

#: Patterns and weights of future work.
FUTURE_WORK = [
    (r"\b(?:in\s+future\s+work|for\s+future\s+(?:work|research|inquiry|study|iterations)|future\s+(?:research|investigations?|studies|work)\s+(?:will|should|could|might|focus))\b", 3.6),
    (r"\bwe\s+(?:plan|intend|hope|aim)\s+to\s+(?:extend|explore|investigate|generalize|apply|evaluate|incorporate|validate|release)\b", 3.4),
    (r"\b(?:leave|leaves)\b.*?\b(?:for|to|as\s+an\s+avenue\s+for)\s+(?:future|subsequent)\s+(?:work|research|inquiry|iterations|studies)\b", 3.6),
    (r"\b(?:promising|natural|interesting|exciting)\s+(?:direction|avenue|next\s+step)\s+(?:for\s+future|to)\b", 3.2),
    (r"\bfurther\s+(?:research|investigation|exploration|study|work)\s+is\s+(?:needed|warranted|required|encouraged)\b", 3.0),
    (r"\brepresents\s+a\s+natural\s+next\s+step\b", 3.2),
    (r"\bremains\s+(?:an?\s+)?(?:open|promising)\s+(?:question|direction|problem|avenue)\s+for\s+future\b", 3.2),
    (r"\bcould\s+be\s+(?:extended|applied|adapted|generalized)\s+to\b", 2.4),
    (r"\ba\s+promising\s+direction\s+is\s+to\b", 2.8),
]

#: Patterns and weights of results.
RESULTS = [
    (r"\boutperforms?\b", 3.5),
    (r"\bachieves?\s+(?:a\s+)?(?:new\s+)?(?:state-of-the-art|SOTA|superior|competitive|higher)\b", 3.5),
    (r"\bimproves?\s+(?:performance|results|accuracy|BLEU|efficiency)\s+(?:by|over)\b", 3.2),
    (r"\bwe\s+observe\s+(?:a\s+)?(?:statistically\s+significant|consistent|substantial)\s+(?:gain|improvement|advantage)\b", 3.2),
    (r"\bresults?\s+(?:demonstrate|show|indicate|reveal|confirm)\s+that\b", 2.8),
    (r"\byields?\s+(?:higher|superior|better|competitive)\b", 2.6),
    (r"\bconsistently\s+beats?\b", 3.0),
    (r"\bestablishes?\s+(?:a\s+)?new\s+benchmark\b", 3.0),
]

#: Fixed value: a numeric gain.
NUMERIC_GAIN = r"(?:improves?|gains?|boosts?|outperforms?|by)\s+(?:an\s+average\s+of\s+)?(\+?\d+(?:\.\d+)?%?)\s*(?:points?|%|BLEU|ROUGE|accuracy)?"

#: Fixed value: a p-value.
P_VALUE = Cue(r"\(?\s*p\s*(?:<|<=|=)\s*0?\.\d+\s*\)?", "<", "=")

#: Templates of method names (case matters).
METHOD_TEMPLATES = [
    r"\b(?:we\s+propose|we\s+introduce|we\s+present)\s+(?:the|a\s+novel)?\s*([A-Z][a-zA-Z0-9_\-]+(?:\s+[A-Z][a-zA-Z0-9_\-]+)?)\b",
    r"\b([A-Z][a-zA-Z0-9_\-]+(?:\s+[A-Z][a-zA-Z0-9_\-]+)?)\s+(?:model|architecture|framework|algorithm|network|mechanism|approach)\b",
    r"\b(?:using|with|via)\s+(?:the\s+)?([A-Z][a-zA-Z0-9_\-]+)\s+(?:algorithm|optimizer|loss|layer)\b",
    r"\bbased\s+on\s+(?:the\s+)?([A-Z][a-zA-Z0-9_\-]+(?:\s+[A-Z][a-zA-Z0-9_\-]+)?)\s+(?:architecture|model)\b",
]

#: Known methods.
CANONICAL_METHODS = [
    "transformer",
    "self-attention",
    "multi-head attention",
    "attention mechanism",
    "lstm",
    "bilstm",
    "gru",
    "rnn",
    "recurrent neural network",
    "cnn",
    "convolutional neural network",
    "bert",
    "roberta",
    "scibert",
    "gpt",
    "gpt-2",
    "gpt-3",
    "gpt-4",
    "llama",
    "resnet",
    "vgg",
    "densenet",
    "gcn",
    "gat",
    "graph neural network",
    "adam",
    "adamw",
    "sgd",
    "backpropagation",
    "beam search",
    "dropout",
    "layernorm",
    "batchnorm",
    "lora",
    "flashattention",
    "contrastive learning",
    "diffusion model",
    "encoder-decoder",
]

#: Templates of dataset names (case matters).
DATASET_TEMPLATES = [
    r"\b([A-Z0-9][a-zA-Z0-9_\-]*(?:\s+[A-Za-z0-9_\-]+){0,3})\s+(?:dataset|benchmark|corpus|corpora|database|testbed)\b",
    r"\b(?:evaluate|evaluated|benchmark|benchmarked|test|tested)\s+on\s+(?:the\s+)?([A-Z0-9][a-zA-Z0-9_\-]+(?:\s+[A-Za-z0-9_\-]+)?)\b",
    r"\b(?:train|trained|fine-tuned)\s+on\s+(?:the\s+)?([A-Z0-9][a-zA-Z0-9_\-]+(?:\s+[A-Za-z0-9_\-]+)?)\b",
]

#: Known datasets.
CANONICAL_DATASETS = [
    "wmt",
    "wmt 2014",
    "wmt14",
    "glue",
    "superglue",
    "squad",
    "squad 2.0",
    "imagenet",
    "cifar-10",
    "cifar-100",
    "mnist",
    "ms coco",
    "coco",
    "conll",
    "penn treebank",
    "multi30k",
    "bookcorpus",
    "wikipedia",
    "pubmed",
    "arxiv",
    "triviaqa",
    "natural questions",
    "snli",
    "mnli",
    "smlmt",
    "ag news",
]

#: Metric names with an optional score.
METRIC_TEMPLATES = [
    r"\b(BLEU(?:-[1-4])?|ROUGE(?:-[12L])?|F1(?:-score)?|Accuracy|Precision|Recall|AUC(?:-ROC)?|mAP(?:@\d+)?|IoU|RMSE|MAE|Perplexity|PPL|Exact\s+Match|EM)\b(?:\s*(?:of|=|:)?\s*(\d+(?:\.\d+)?%?))?",
    r"\b(mean\s+squared\s+error|cross-entropy\s+loss|error\s+rate|top-[15]\s+accuracy)\b(?:\s*(?:of|=|:)?\s*(\d+(?:\.\d+)?%?))?",
]

#: Abbreviations whose periods end no sentence.
ABBREVIATIONS = [
    "e.g.",
    "i.e.",
    "et al.",
    "etc.",
    "cf.",
    "viz.",
    "vs.",
    "v.",
    "ca.",
    "ibid.",
    "op. cit.",
    "fig.",
    "figs.",
    "eq.",
    "eqs.",
    "eqn.",
    "eqns.",
    "ref.",
    "refs.",
    "sec.",
    "secs.",
    "tab.",
    "tabs.",
    "vol.",
    "vols.",
    "no.",
    "nos.",
    "pp.",
    "p.",
    "ch.",
    "app.",
    "dr.",
    "prof.",
    "mr.",
    "mrs.",
    "ms.",
    "univ.",
    "dept.",
    "assoc.",
    "proc.",
    "conf.",
    "u.s.",
    "u.k.",
    "ph.d.",
    "m.sc.",
    "b.sc.",
    "approx.",
    "min.",
    "sec.",
    "hr.",
]

#: Canonical names by written form.
CANONICAL_ENTITIES = {
    "bert": "BERT",
    "bert base": "BERT",
    "bert large": "BERT",
    "roberta": "RoBERTa",
    "transformer": "Transformer",
    "transformers": "Transformer",
    "vanilla transformer": "Transformer",
    "flashattention": "FlashAttention",
    "flash attention": "FlashAttention",
    "flash-attention": "FlashAttention",
    "cnn": "CNN",
    "convolutional neural network": "CNN",
    "convolutional neural networks": "CNN",
    "gnn": "GNN",
    "graph neural network": "GNN",
    "lstm": "LSTM",
    "hdbscan": "HDBSCAN",
    "bertopic": "BERTopic",
    "kmeans": "K-Means",
    "k-means": "K-Means",
    "umap": "UMAP",
    "state space model": "State Space Model",
    "state space models": "State Space Model",
    "mamba": "Mamba",
    "squad": "SQuAD",
    "squad v1.1": "SQuAD",
    "squad v2.0": "SQuAD",
    "glue": "GLUE",
    "superglue": "SuperGLUE",
    "imagenet": "ImageNet",
    "multinli": "MultiNLI",
    "pubmed": "PubMed",
    "mimic": "MIMIC",
    "mimic-iii": "MIMIC-III",
    "arxiv": "arXiv",
    "cross-domain adaptation": "Cross-Domain Adaptation",
    "domain adaptation": "Domain Adaptation",
    "out-of-distribution generalization": "Out-of-Distribution Generalization",
    "scientific text summarization": "Scientific Text Summarization",
    "text summarization": "Text Summarization",
    "summarization": "Text Summarization",
    "evidence extraction": "Evidence Extraction",
    "citation graph representation": "Citation Graph Representation",
    "contrastive representation learning": "Contrastive Representation Learning",
    "question answering": "Question Answering",
}

#: Fixed value: cues of a relation.
PROPOSES_CUES = r"\b(we propose|we introduce|we present|we develop|our approach|our model|our framework|in this work we)\b"

#: Fixed value: cues of a relation.
EXTENDS_CUES = r"\b(we extend|extends|building upon|build upon|modified version of|extension of|adapted from|following the formulation)\b"

#: Fixed value: cues of a relation.
COMPARES_CUES = r"\b(compared (with|to)|baseline|outperforms|in comparison with|evaluated against|versus|vs\.?|competing methods)\b"

#: Fixed value: cues of a relation.
USES_CUES = r"\b(we use|we employ|we utilize|trained on|fine-tuned on|evaluated on the|dataset|using the|tested on)\b"

#: Fixed value: cues of a relation.
ADDRESSES_CUES = r"\b(address|addresses|addressing|to overcome|mitigates|resolves|tackles|alleviates|circumvents|solves the bottleneck)\b"
#: Fixed value: verbs of a sentence that takes on another paper's limitation.
SOLVING_VERBS = r"\b(address|overcome|mitigate|solve|tackle|resolve)\b"

#: Fixed value: cues of a relation.
SUPPORTS_CUES = r"\b(confirms|demonstrates|validates|supports the hypothesis|consistent with|corroborates|proves the efficacy)\b"

#: Fixed value: cues of a relation.
CONTRADICTS_CUES = r"\b(contradicts|contrary to|disputes|fails to reproduce|in contrast to prior|does not hold|refutes|inconsistent with)\b"

#: Inference cues.
REFUTATION_PATTERNS = [
    r"\b(disprove[sd]?|refute[sd]?|debunk(ed|s)?|invalidat(ed|es)?)\b",
    r"\b(no longer a (bottleneck|limitation|constraint|hurdle))\b",
    r"\b(not a (limitation|bottleneck|problem))\b",
    r"\b(fails to hold|does not degrade|no performance degradation)\b",
    r"\b(completely resolve[sd]?|overcomes? the (quadratic|bottleneck|constraint))\b",
    r"\b(without (any )?degradation|linear complexity is achieved without loss)\b",
    r"\b(contrary to (prior|previous) (claims|findings|belief))\b",
    r"\b(unsubstantiated|empirically unfounded|misconception)\b",
]

#: Inference cues.
ENTAILMENT_PATTERNS = [
    r"\b(confirm[sd]? the (bottleneck|limitation|overhead))\b",
    r"\b(remains? (quadratic|unresolved|a bottleneck|a challenge|an open problem))\b",
    r"\b(persists? (across|in|over)|continues to (constrain|limit|degrade))\b",
    r"\b(severe (memory overhead|degradation|bottleneck|constraint))\b",
    r"\b(corroborates? (that|previous findings))\b",
    r"\b(prevents? scaling|limits? scalability)\b",
]

#: Inference cues.
ADDRESSED_PATTERNS = [
    r"\b(we (propose|introduce|develop) .+ to (solve|mitigate|address))\b",
    r"\b(effectively (resolves?|mitigates?|addresses?))\b",
    r"\b(alleviates? the (bottleneck|overhead|constraint))\b",
]

#: The six steps (name, description, relation) of each genealogy; {} stands for the gap's title or description.
GENEALOGY = {
    "memory": [
        ("High Computational Memory Overhead", "Self-attention complexity scales quadratically with sequence length.", "limited_by"),
        ("Sparse & Linear Attention Approximation", "Proposed sparse and factorized attention to reduce memory footprint.", "proposes"),
        ("Approximation Degradation on Complex Reasoning", "Linear attention approximations fail on complex multi-hop reasoning tasks.", "limited_by"),
        ("Hardware-Aware Kernel Fusion", "Fused memory-efficient attention kernels developed for specialized GPUs.", "extends"),
        ("SRAM Bandwidth Bottlenecks at Ultra-Long Contexts", "Remaining memory bandwidth constraints prevent scaling beyond 64k tokens.", "limited_by"),
        ("Current Potential Gap: {title}", "{description}", "current_potential_gap"),
    ],
    "domain": [
        ("Large In-Domain Supervised Data Requirement", "Models require massive amounts of labeled in-domain data to achieve convergence.", "limited_by"),
        ("Unsupervised Data Augmentation & Synthesis", "Employed synthetic data generation and back-translation to augment datasets.", "proposes"),
        ("Out-of-Distribution Generalization Degradation", "Augmented models suffer severe performance drops when applied to out-of-domain text.", "limited_by"),
        ("Domain Adversarial Adaptation", "Introduced gradient reversal and domain adaptation discriminators.", "extends"),
        ("Negative Transfer & Alignment Drift", "Domain adaptation causes performance degradation on source domain data.", "limited_by"),
        ("Current Potential Gap: {title}", "{description}", "current_potential_gap"),
    ],
    "data": [
        ("Expert Annotation Scarcity", "Clinical and technical domain annotation costs prohibit large-scale supervision.", "limited_by"),
        ("Weak Supervision & Heuristic Labeling", "Applied programmatic labeling heuristics and weak label aggregators.", "proposes"),
        ("Label Noise Propagation", "Heuristic rules introduce systematic label noise that corrupts downstream learning.", "limited_by"),
        ("Contrastive Self-Supervision", "Trained representations via unsupervised contrastive pairs on unlabeled text.", "extends"),
        ("Biased Representation Drift", "Unsupervised representations fail to capture fine-grained clinical semantics.", "limited_by"),
        ("Current Potential Gap: {title}", "{description}", "current_potential_gap"),
    ],
    "other": [
        ("Foundational Bottleneck: {title}", "Initial empirical limitation observed regarding {title}.", "limited_by"),
        ("Heuristic Optimization Attempt", "Early architectural modifications proposed to alleviate the bottleneck.", "proposes"),
        ("Sub-Optimal Evaluation Bounds", "Proposed heuristics introduce accuracy trade-offs under high-load conditions.", "limited_by"),
        ("Algorithmic Specialization", "Domain-specific fine-tuning implemented to bypass constraints.", "extends"),
        ("Scalability & Generalization Ceiling", "Specialized models reach an empirical performance ceiling.", "limited_by"),
        ("Current Potential Gap: {title}", "{description}", "current_potential_gap"),
    ],
}

#: Letters joined in print and what they stand for.
LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "ft", "\ufb06": "st", "\u0152": "OE", "\u0153": "oe", "\u00c6": "AE", "\u00e6": "ae"}

#: Names of paper sections.
KNOWN_SECTIONS = ["abstract", "introduction", "related work", "background", "literature review", "methodology", "method", "methods", "approach", "system architecture", "proposed method", "materials and methods", "experiments", "experimental setup", "evaluation", "results", "results and discussion", "discussion", "limitations", "threats to validity", "future work", "conclusion", "conclusions", "conclusions and future work", "acknowledgments", "acknowledgements", "references", "bibliography", "appendix"]

#: Words that say little about a statement.
OVERLAP_STOP_WORDS = ["the", "a", "an", "is", "are", "was", "were", "and", "or", "in", "on", "at", "to", "for", "of", "with", "by", "that", "this", "these", "those", "it", "we", "our", "they", "their", "from", "as", "be", "been", "has", "have"]

#: Names that templates catch by mistake.
NO_METHODS = ["this", "that", "these", "such", "previous", "existing", "our"]
NO_DATASETS = ["our", "this", "each", "both", "all", "small", "large", "new", "test", "training"]

#: Keyword groups of recurring limitations, in order, and the key of each.
LIMITATION_KEYS = [
    (r"\b(memory|quadratic|scal|overhead|compute|computation|gpu)\b", "computational memory overhead"),
    (r"\b(transfer|generaliz|cross-domain|domain|out-of-distribution)\b", "cross-domain generalization degradation"),
    (r"\b(data|scarcity|annotat|label|small dataset|few samples)\b", "annotated data scarcity"),
    (r"\b(hallucinat|factual|evaluat|metric|bias)\b", "evaluation bias and factual hallucinations"),
]
NO_KEY_WORDS = ["approach", "limitation", "paper", "model"]

#: Cues of timeline events.
STILL_OPEN = r"\b(unresolved|unsolved|re-emerge|reopen|persists?|still|remains?)\b"
PARTLY_OPEN = r"\b(partially|partial|mitigat|residual)\b"
REOPENED = r"\b(re-emerge|reopen)\b"
SOLVED = r"\b(solve[ds]?|resolv(es|ed)|mitigat(es|ed)|overcom(es|ing)|address(es|ed)|solution|we propose)\b"
PARTLY_SOLVED = r"\b(partially|partial|residual)\b"

#: Phrases that sort evidence.
REFUTING = ["disprove", "refute", "no longer a bottleneck", "does not degrade", "without loss"]
SOLVING = ["we propose", "solve the bottleneck", "overcome the", "effectively resolves", "mitigate"]

#: Weight of each signal in a gap's priority.
SIGNAL_WEIGHTS = {"repeated_limitation": 0.25, "underexplored": 0.20, "temporal_opportunity": 0.15, "cross_domain": 0.15, "conflicting_evidence": 0.10, "method_concentration": 0.08, "dataset_concentration": 0.07}
